"""The folder layout of run results as a data source: one JSON file a run, named by its id, and an index of them.

``df.write.format("run_files").option("path", p)`` writes ``p/simulations/<id>.json``
and, when all tasks have ended, ``p/index/``: a part of JSON lines for every task
with rows, of the columns in ``INDEX`` that the runs have. A task that is repeated
writes the same files again, and only parts of tasks that succeeded enter the
index; a job that fails takes its index parts with it. ``spark.read.format("run_files")``
compares index and files both ways before it reads, and raises if they differ; it
deals the files out some ``FILES_A_TASK`` a task. Files are reached through Arrow's
file systems, so a path may be a URI. The driver lists file names and ids, not runs.
Many runs go in packs (:func:`tracemill.sources.results.save_runs`), which this format refuses.

An id is a file name: null, empty, and those with a slash are refused.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: Columns of the index.
INDEX = ("id", "task_id", "trial", "reward", "termination_reason", "agent_cost", "duration")
FILES_A_TASK = 500
#: Suffix of files with many runs, a line each.
PACK = ".json.gz"


def file_system(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    # Spark writes local URIs with one slash.
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _names(fs, folder: str, suffix: str = ".json") -> list[str]:
    from pyarrow.fs import FileSelector, FileType

    found = fs.get_file_info(FileSelector(folder, allow_not_found=True))
    return sorted(posixpath.basename(f.path) for f in found if f.type == FileType.File and not posixpath.basename(f.path).startswith((".", "_")) and f.path.endswith(suffix))


def packed(path: str) -> bool:
    """Whether runs, or their index, lie in packs."""
    fs, root = file_system(path)
    return any(_names(fs, posixpath.join(root, folder), PACK) for folder in ("simulations", "index"))


def _documents(fs, path: str) -> Iterator[dict]:
    """The JSON documents of a file, one or many, over lines as they like."""
    with fs.open_input_stream(path) as f:
        text = f.read().decode()
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            return
        found, at = decoder.raw_decode(text, at)
        yield from found if isinstance(found, list) else [found]


def read_index(path: str) -> list[str]:
    fs, root = file_system(path)
    folder = posixpath.join(root, "index")
    return [str(d["id"]) for name in _names(fs, folder) for d in _documents(fs, posixpath.join(folder, name))]


def integrity(path: str) -> list[tuple[str, str]]:
    """(id, what is wrong): ``missing`` has no file, ``extra`` no entry in the index, ``repeated`` more than one."""
    fs, root = file_system(path)
    listed = read_index(path)
    files = {unquote(n.removesuffix(".json")) for n in _names(fs, posixpath.join(root, "simulations"))}
    once = set(listed)
    seen: set[str] = set()
    repeated = {i for i in listed if i in seen or seen.add(i)}
    return sorted([(i, "missing") for i in once - files] + [(i, "extra") for i in files - once] + [(i, "repeated") for i in repeated])


@dataclass
class Files(InputPartition):
    paths: list[str]


class RunFilesReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Files]:
        if packed(self.path):
            raise ValueError(f"packs of runs are read by load_runs: {self.path}")
        bad = integrity(self.path)
        if bad:
            raise ValueError("index and files differ: " + ", ".join(f"{i} ({what})" for i, what in bad[:10]))
        fs, root = file_system(self.path)
        names = _names(fs, posixpath.join(root, "simulations"))
        return [Files(names[k : k + FILES_A_TASK]) for k in range(0, len(names), FILES_A_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(self.path)
        schema = to_arrow_schema(self.schema)
        for k in range(0, len(partition.paths), 100):
            rows = [d for n in partition.paths[k : k + 100] for d in _documents(fs, posixpath.join(root, "simulations", n))]
            yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in schema.names} for r in rows], schema=schema)


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class RunFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        self.staged = f"_staged-{uuid.uuid4().hex}"
        from pyarrow.fs import FileType

        fs, root = file_system(path)
        if fs.get_file_info(root).type != FileType.NotFound:
            if not overwrite:
                raise FileExistsError(f"PATH_ALREADY_EXISTS: {path}")
            fs.delete_dir(root)
        for folder in ("simulations", "index", self.staged):
            fs.create_dir(posixpath.join(root, folder), recursive=True)

    def write(self, iterator: Iterator[Row]) -> Part:
        fs, root = file_system(self.path)
        index: list[str] = []
        for row in iterator:
            run = row.asDict(recursive=True)
            name = run.get("id")
            if name is None or not str(name) or "/" in str(name):
                raise ValueError(f"not an id that a file can have: {name!r}")
            place = posixpath.join(root, "simulations", quote(str(name), safe=" ,;:@+=()~!'") + ".json")
            # A file appears whole or not at all, whichever attempt of a task wrote it.
            begun = f"{place}.{uuid.uuid4().hex}"
            with fs.open_output_stream(begun) as f:
                f.write(json.dumps(run, default=str, ensure_ascii=False).encode())
            fs.move(begun, place)
            index.append(json.dumps({k: run[k] for k in INDEX if k in run}, default=str, ensure_ascii=False))
        if not index:
            return Part(None)
        name = f"part-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(posixpath.join(root, self.staged, name)) as f:
            f.write("\n".join(index).encode())
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.move(posixpath.join(root, self.staged, m.name), posixpath.join(root, "index", m.name))
        fs.delete_dir(posixpath.join(root, self.staged))

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = file_system(self.path)
        fs.delete_dir(posixpath.join(root, self.staged))


class RunFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_files"

    def schema(self) -> str:
        return "id string, task_id string, trial int, reward double, termination_reason string, agent_cost double, duration double"

    def reader(self, schema: T.StructType) -> RunFilesReader:
        return RunFilesReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> RunFilesWriter:
        return RunFilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; its classes travel by value, so that executors need not have the package."""
    from pyspark import cloudpickle

    import tracemill

    cloudpickle.register_pickle_by_value(tracemill)
    spark.dataSource.register(RunFiles)
