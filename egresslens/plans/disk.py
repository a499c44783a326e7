"""Disk triage: an inventory against a target list, with network and USB evidence."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from egresslens import constants as C
from egresslens.operators import filters, fuzzy, match, usb as devices
from egresslens.session import materialize
from egresslens.sources import sinks


@dataclass
class DiskTriage:
    files: DataFrame
    matches: DataFrame
    network: DataFrame
    usb: DataFrame

    def summary(self) -> DataFrame:
        return match.report_summary(self.matches, self.network, self.usb)

    def text_report(self) -> DataFrame:
        return sinks.text_report(self.matches, self.network, self.usb, self.summary())


def match_files(files: DataFrame, targets: DataFrame, min_score: int = C.SSDEEP_MIN_SCORE,
                max_distance: int = C.TLSH_MAX_DISTANCE, use_fuzzy: bool | None = None,
                keys=("path",)) -> DataFrame:
    """One match per path, exact before similar.

    Similarity matching is planned only when the list holds similarity digests.
    """
    columns = [*files.columns, "match_type", "score"]
    exact = match.exact_match_types(files, targets)
    found = exact.selectExpr("*", "CAST(NULL AS double) AS score").select(*columns)
    if match.needs_fuzzy(targets) if use_fuzzy is None else use_fuzzy:
        similar = fuzzy.fuzzy_matches(files, targets, min_score, max_distance)
        if similar is not None:
            found = found.unionByName(similar.select(*columns))
    return match.first_per_path(found, keys)


def run_with_logs(files: DataFrame, targets: DataFrame, objects: DataFrame, log_lines: DataFrame,
                  registry_keys: DataFrame | None = None, **options) -> DiskTriage:
    """As ``run``, with device records from log lines ``(file, line_no, line)`` and extracted registry keys.

    Files that yielded a record leave the hash stream; keys name theirs in a column ``file``, where they have one.
    """
    linux = materialize(devices.linux_usb_events(log_lines), "log-devices")
    sources = linux.select("file")
    if registry_keys is not None and "file" in registry_keys.columns:
        sources = sources.unionByName(registry_keys.select("file"))
    return run(files, targets, objects, devices.usb_events(linux, registry_keys), sources, **options)


def run(files: DataFrame, targets: DataFrame, objects: DataFrame, usb: DataFrame,
        usb_sources: DataFrame | None = None, **options) -> DiskTriage:
    """``objects`` are carried files, ``usb`` device records, ``usb_sources`` the files they came from."""
    scanned = filters.non_empty_files(files)
    if usb_sources is not None:
        scanned = filters.without_usb_files(scanned, usb_sources)
    # Hashing reads whole contents, so the described inventory is written once and used from there.
    typed = materialize(filters.type_prefix_filter(scanned, targets), "inventory")
    targets = materialize(targets, "targets")
    return DiskTriage(typed, match_files(typed, targets, **options), match.network_matches(objects, targets), usb)
