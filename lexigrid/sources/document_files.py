"""A sink of one named file a document, as a data source of Spark: rows are written where they are and files appear when all tasks are done."""

from __future__ import annotations

import csv
import io
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lexigrid.operators.durable import cut

STAGED = "_temporary"

#: Names or lines in a batch that a task hands on, and the characters of such lines.
ROWS, CHARACTERS = 1000, 1 << 20


def file_system(path: str):
    """The store of a path and the path inside it; whatever Arrow can reach, local folders included."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def checked_name(name: str) -> str:
    """A file's name, which may have folders but must stay below the sink's own."""
    parts = name.split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..") for p in parts) or parts[0] == STAGED:
        raise ValueError(f"no name for a file: {name!r}")
    return name


def moved(store, path: str, folder: str):
    """Move an attempt's files into place and yield their names; what a lost task has moved before is there already."""
    from pyarrow import fs

    made = None
    with store.open_input_stream(f"{folder}.names") as listed:
        for line in io.TextIOWrapper(listed, encoding="utf-8"):
            name = json.loads(line)
            source, target = f"{folder}/{name}", f"{path}/{name}"
            parent = target.rpartition("/")[0]
            if parent != made:
                store.create_dir(parent, recursive=True)
                made = parent
            try:
                store.move(source, target)
            except OSError:
                left, there = store.get_file_info([source, target])
                if left.type != fs.FileType.NotFound or there.type != fs.FileType.File:
                    raise
            yield name


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class DocumentFiles(DataSource):
    """``df.write.format("document_files")``: options path, name (the column that names the file) and kind: tsv with a header, or text,
    whose rows have one other column, a line each. The rows of a name have to be in one partition, one after the other. The driver moves
    the files into place, unless the option job gives a name: then it leaves a list of accepted folders for ``write_documents``, whose tasks do."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(dict(self.options), schema.fieldNames(), overwrite)


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.key, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("name", "filename"), options.get("kind", "tsv"), overwrite
        self.job = options.get("job")
        self.at, self.columns = columns.index(self.key), [c for c in columns if c != self.key]

    def write(self, iterator) -> Written:
        """A folder of this attempt's own gets the files, and a list beside it their names; no other attempt ever writes there."""
        store, path = file_system(self.path)
        folder = f"{path}/{STAGED}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        names = io.TextIOWrapper(store.open_output_stream(f"{folder}.names"), encoding="utf-8")
        name, out, n, made = None, None, 0, folder
        for row in iterator:
            values = list(row)
            here = values.pop(self.at)
            if here != name:
                if out is not None:
                    out.close()
                name, n = here, n + 1
                target = f"{folder}/{checked_name(name)}"
                if target.rpartition("/")[0] != made:
                    made = target.rpartition("/")[0]
                    store.create_dir(made, recursive=True)
                names.write(json.dumps(name) + "\n")
                out = io.TextIOWrapper(store.open_output_stream(target), encoding="utf-8", newline="")
                lines = csv.writer(out, delimiter="\t", lineterminator="\n")
                if self.kind == "tsv":
                    lines.writerow(self.columns)
            if self.kind == "tsv":
                lines.writerow(["" if v is None else v for v in values])
            else:
                out.write(f"{'' if values[0] is None else values[0]}\n")
        if out is not None:
            out.close()
        names.close()
        return Written(folder, n)

    def commit(self, messages) -> None:
        """Only files of tasks that Spark has accepted are moved into place; all other attempts go with the staging folder."""
        from pyarrow import fs

        store, path = file_system(self.path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if old.base_name != STAGED:
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        store.create_dir(path, recursive=True)

        accepted = [m.folder for m in messages if m is not None and m.files]
        if self.job:
            store.create_dir(f"{path}/{STAGED}", recursive=True)
            with store.open_output_stream(f"{path}/{STAGED}/{self.job}.accepted") as out:
                out.write(json.dumps(accepted).encode())
            return
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda folder: sum(1 for _ in moved(store, path, folder)), accepted))
        self._clear(store, path)

    def abort(self, messages) -> None:
        self._clear(*file_system(self.path))

    @staticmethod
    def _clear(store, path) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{path}/{STAGED}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{STAGED}")


def write_documents(df: DataFrame, path: str, name: str = "filename", order: list | None = None, kind: str = "tsv", mode: str = "overwrite") -> DataFrame:
    """One file a document, named by the column ``name``, its rows in order of ``order``. Rows without a name go nowhere. Returns the names.

    A document's rows are one partition's, as they are one file; they are sorted on the way and streamed, so that a long one is held by
    no task. Partitions are not merged by their bytes, since files cost more than what is in them. A job that fails leaves what was there
    before. Tasks move the files into place once all are written; the driver knows a folder a task and no file.
    """
    spark, job = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(DocumentFiles)
    rows = df.filter(F.col(name).isNotNull() & (F.col(name) != "")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), name)
    rows.sortWithinPartitions(name, *(order or [])).write.format("document_files").options(path=path, name=name, kind=kind, job=job).mode(mode).save()
    store, base = file_system(path.rstrip("/"))
    with store.open_input_stream(f"{base}/{STAGED}/{job}.accepted") as listed:
        folders = json.loads(listed.read())

    def place(batches):
        import pyarrow as pa

        at, below = file_system(path.rstrip("/"))
        for batch in batches:
            for i in batch.column(0).to_pylist():
                names = moved(at, below, folders[i])
                while some := list(islice(names, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], [name])

    try:
        return cut(spark.range(0, len(folders), 1, max(1, len(folders))).mapInArrow(place, f"`{name}` string"))
    finally:
        FileWriter._clear(store, base)


def document_lines(names: DataFrame, path: str, name: str = "filename") -> DataFrame:
    """(name, line, value): the lines, from 0, of the files in ``path`` that ``names`` has. A file is streamed where its name is; no folder is listed."""

    def read(batches):
        import pyarrow as pa

        store, base = file_system(path.rstrip("/"))
        held, size = [], 0

        def batch_of(rows):
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], [name, "line", "value"])

        for batch in batches:
            for here in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{checked_name(here)}") as content:
                    for at, value in enumerate(io.TextIOWrapper(content, encoding="utf-8", newline="\n")):
                        held.append((here, at, value.removesuffix("\n")))
                        size += len(value)
                        if len(held) >= ROWS or size >= CHARACTERS:
                            yield batch_of(held)
                            held, size = [], 0
        if held:
            yield batch_of(held)

    return names.select(name).mapInArrow(read, f"`{name}` string, line bigint, value string")
