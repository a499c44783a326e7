"""Exact matching of inventories and carried files with a target list."""

from pyspark.sql import Column, DataFrame, functions as F

from egresslens.schemas import require_columns

REQUIRED = ("path", "sha256", "md5")
PRIORITY = {"sha256": 1, "md5": 2, "ssdeep": 3, "tlsh": 4}


def target_values(targets: DataFrame, column: str) -> DataFrame:
    return targets.select(column).dropna().distinct()


def hash_match(files: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """Files whose digest is on the list; a semi join, so a file never repeats."""
    return files.join(target_values(targets, column), column, "left_semi").select(*files.columns)


def exact_matches(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Bag of sha256 and md5 matches with their ``match_type``."""
    require_columns(files, REQUIRED)
    require_columns(targets, REQUIRED)
    by = lambda column: hash_match(files, targets, column).withColumn("match_type", F.lit(column))
    return by("sha256").unionByName(by("md5"))


def exact_match_types(files: DataFrame, targets: DataFrame) -> DataFrame:
    """The best exact match of each file row, with one pass over the files."""
    require_columns(files, REQUIRED)
    require_columns(targets, REQUIRED)
    flagged = files
    for column in ("sha256", "md5"):
        known = target_values(targets, column).select(F.col(column).alias("__t"))
        # rows without a digest would all meet in one task; a text that no digest equals spreads them
        own = F.coalesce(F.col(column), F.concat(F.lit("~"), F.xxhash64("path").cast("string")))
        flagged = flagged.withColumn("__own", own).join(known, F.col("__own") == F.col("__t"), "left").withColumn(
            f"__{column}", F.col("__t").isNotNull()).drop("__t", "__own")
    kind = F.when(F.col("__sha256"), "sha256").when(F.col("__md5"), "md5")
    return flagged.withColumn("match_type", kind).drop("__sha256", "__md5").filter(
        F.col("match_type").isNotNull())


def match_priority() -> Column:
    kind = F.regexp_extract("match_type", "^[a-z0-9]+", 0)
    out = F.lit(len(PRIORITY) + 1)
    for name, rank in PRIORITY.items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def first_per_path(matches: DataFrame, keys=("path",)) -> DataFrame:
    """One match per path: sha256, md5, ssdeep, tlsh, then the best score, then the first partition.

    An aggregate rather than a window, so rows combine before the shuffle.
    """
    score = F.col("score") if "score" in matches.columns else F.lit(None).cast("double")
    better = F.when(F.startswith("match_type", F.lit("tlsh")), score).otherwise(-score)
    order = F.struct(match_priority(), F.coalesce(better, F.lit(0.0)), F.col("partition_offset"))
    rest = [c for c in matches.columns if c not in keys]
    best = matches.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("m"))
    return best.select(*keys, "m.*").select(*matches.columns)


def target_hash_set(targets: DataFrame, columns=("sha256", "md5", "ssdeep", "tlsh")) -> DataFrame:
    """All distinct digests of the target list as one column."""
    values = F.array(*[F.col(c) for c in columns if c in targets.columns])
    return targets.select(F.explode(values).alias("hash")).dropna().distinct()


def network_matches(objects: DataFrame, targets: DataFrame) -> DataFrame:
    """Carried files whose sha256 is in the target hash set."""
    hashes = target_hash_set(targets).select(F.col("hash").alias("sha256"))
    return objects.join(hashes, "sha256", "left_semi").select(*objects.columns)


def match_counts(matches: DataFrame) -> DataFrame:
    exact = F.col("match_type").isin("sha256", "md5")
    return matches.agg(F.count_if(exact).alias("exact_matches"),
                       F.count_if(~exact).alias("fuzzy_matches"))


def report_summary(matches: DataFrame, network: DataFrame, usb: DataFrame) -> DataFrame:
    """Counts of the report head: allocated, deleted, network, usb."""
    size = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return matches.agg(
        F.count_if(~F.col("deleted")).alias("allocated"), F.count_if("deleted").alias("deleted")
    ).select("*", size(network).alias("network"), size(usb).alias("usb"))


def combined_targets(*lists: DataFrame) -> DataFrame:
    """Union of target lists, one row per path: the first list that names it wins."""
    tagged = None
    for rank, targets in enumerate(lists):
        part = targets.withColumn("__rank", F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in ("path", "__rank")]
    row = F.struct(*rest)
    return tagged.groupBy("path").agg(F.min_by(row, F.struct("__rank", row)).alias("r")).select("path", "r.*")


def with_content(matches: DataFrame, contents: DataFrame) -> DataFrame:
    """Matched files joined back to their content for export."""
    wanted = contents.select("path", F.col("content"))
    return matches.join(wanted, "path")


def needs_fuzzy(targets: DataFrame) -> bool:
    """Whether the list holds any similarity digest, decided once per run."""
    present = [c for c in ("ssdeep", "tlsh") if c in targets.columns]
    return bool(present) and not targets.select(*present).dropna(how="all").isEmpty()
