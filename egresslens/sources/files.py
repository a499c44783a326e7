"""Contents written as files, by a data source with commit and abort.

A task writes its files below a staging folder of its own; nothing is visible before the job commits.
Then the driver moves one folder a task into place and removes the staging folder, in which
tasks that failed or ran twice have left theirs. A job that fails leaves nothing: its staging folder is
moved away before it is removed, and tasks that still run make no folder without it.
"""

from collections.abc import Iterator
from dataclasses import dataclass
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "content_files"
_STAGING = "_staging"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def safe_path(path: str) -> str:
    """The path below a folder: no root, no steps up, no empty steps."""
    steps = [s for s in path.replace("\\", "/").split("/") if s not in ("", ".", "..")]
    return "/".join(steps) or "unnamed"


@dataclass
class _Written(WriterCommitMessage):
    folder: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, job: str) -> None:
        self.path, self.job = path.rstrip("/"), job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _place(self.path)
        folder, names, made = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", {}, set()
        for batch in iterator:
            columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("path", "content"))
            for path, content in zip(*columns):
                name = safe_path(path or "")
                names[name] = again = names.get(name, -1) + 1
                target = f"{root}/{_STAGING}/{self.job}/{folder}/{name}" + (f"~{again}" if again else "")
                self._make_above(store, target, root, made)
                with store.open_output_stream(target) as out:
                    out.write(content or b"")
        return _Written(folder if names else None)

    def _make_above(self, store: fs.FileSystem, target: str, root: str, made: set[str]) -> None:
        """The folders of a file, one after the other below the job's own, which only the driver makes."""
        above = f"{root}/{_STAGING}/{self.job}"
        for step in target[len(above) + 1:].split("/")[:-1]:
            above = f"{above}/{step}"
            if above not in made:
                store.create_dir(above, recursive=False)
                made.add(above)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _place(self.path)
        for message in messages:
            if message is not None and message.folder:
                store.move(f"{root}/{_STAGING}/{self.job}/{message.folder}", f"{root}/{message.folder}")
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{_STAGING}").type != fs.FileType.NotFound:
            gone = f"{root}/{_STAGING}-{uuid.uuid4().hex}"
            store.move(f"{root}/{_STAGING}", gone)
            store.delete_dir(gone)


class ContentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        writer = _Writer(self.options["path"], uuid.uuid4().hex)
        store, root = _place(writer.path)
        store.create_dir(f"{root}/{_STAGING}/{writer.job}")
        return writer


def write_content_files(rows: DataFrame, path: str) -> None:
    """Write ``(path, content)`` rows as files below ``path``, in one folder a task.

    Two rows of one path in a task get names that differ at the end. Null paths and contents are empty ones. The file
    system must be one that ``pyarrow.fs`` knows.
    """
    rows.sparkSession.dataSource.register(ContentFiles)
    rows.select("path", "content").write.format(FORMAT).mode("append").save(path)


#: Bytes of contents that a reading task hands on at once.
_BATCH_BYTES = 8_000_000


def _hidden(name: str) -> bool:
    """Whether Spark's file readers pass a path over for the name of one of its steps."""
    return any(step.startswith(".") or (step.startswith("_") and "=" not in step) for step in name.split("/"))


def read_content_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of files written so, with their paths below the folders of the tasks.

    Each folder is listed and read by a task of its own, so that no names of files pass through the driver. Empty and
    hidden files are passed over, as by Spark's file readers.
    """
    store, root = _place(path.rstrip("/"))
    below = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    folders = sorted(f.base_name for f in below if f.type == fs.FileType.Directory and f.base_name.startswith("part-"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(path.rstrip("/"))
        for folder in (f"{root}/{folders[i]}" for batch in batches for i in batch.column(0).to_pylist()):
            names, contents, held = [], [], 0
            for info in store.get_file_info(fs.FileSelector(folder, recursive=True)):
                name = info.path[len(folder) + 1:]
                if info.type != fs.FileType.File or not info.size or _hidden(name):
                    continue
                if held and held + info.size > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    names, contents, held = [], [], 0
                with store.open_input_stream(info.path) as file:
                    names.append(name)
                    contents.append(file.read())
                held += info.size
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return spark.range(0, len(folders), 1, max(len(folders), 1)).mapInArrow(read, "path string, content binary")
