"""An append-only table with a commit log: what a micro-batch wrote counts once its entry is there, and only once.

Every batch writes a folder of its own under ``data`` and then one entry under
``log``: the writer and batch id, the folder, and the range of its first key
column. A batch whose entry is there is skipped; a folder without an entry (the
writer was lost between the two) is never read. A batch that is new is held
against the folders whose key range meets its own, so with keys that grow the cost
of a batch does not grow with the table. Every ``COMPACT`` entries one file takes in
all before it, so the log is read from few files. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT = 20


class CommitLog:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _files(self) -> list[str]:
        place, fs = self._fs(f"{self.path}/log")
        return sorted(f.getPath().getName() for f in fs.listStatus(place) if f.getPath().getName().endswith(".json")) if fs.exists(place) else []

    def _read(self, name: str) -> list[dict]:
        place, fs = self._fs(f"{self.path}/log/{name}")
        stream = fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def entries(self) -> list[dict]:
        """All entries in order: those of the last file that takes in the ones before, and of the files after it."""
        names = self._files()
        whole = max((k for k, n in enumerate(names) if n.endswith("-all.json")), default=-1)
        return [e for n in names[max(0, whole) :] for e in self._read(n)]

    def _append(self, entries: list[dict], entry: dict) -> None:
        number = len(entries)
        takes_in = (number + 1) % COMPACT == 0
        name = f"{number:012d}{'-all' if takes_in else ''}.json"
        final, fs = self._fs(f"{self.path}/log/{name}")
        begun, _ = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = fs.create(begun)
        out.write(json.dumps([*entries, entry] if takes_in else [entry]).encode())
        out.close()
        if fs.exists(final) or not fs.rename(begun, final):
            raise RuntimeError(f"another writer has committed {name}")

    def write(self, batch: DataFrame, writer: str, batch_id: int) -> str | None:
        """Write the batch's new rows; the folder, or None where there is nothing to commit."""
        entries = self.entries()
        if any(e["writer"] == writer and e["batch"] == batch_id for e in entries):
            return None
        first = self.keys[0]
        lo, hi, n = batch.agg(F.min(first), F.max(first), F.count("*")).first()
        new = batch.dropDuplicates(self.keys)
        # A null key has no place in a range, so folders with one meet every batch with one.
        nulls = bool(n) and bool(batch.where(F.col(first).isNull()).limit(1).count())
        near = [e["folder"] for e in entries if e["folder"] and (nulls and e["nulls"] or lo is not None and e["lo"] is not None and e["lo"] <= self._plain(hi) and self._plain(lo) <= e["hi"])]
        if near:
            known = self.spark.read.schema(batch.schema).parquet(*[f"{self.path}/data/{f}" for f in near])
            same = None
            for k in self.keys:
                c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
                same = c if same is None else same & c
            new = new.alias("a").join(known.select(*self.keys).alias("b"), same, "left_anti")
        folder = f"{batch_id:012d}-{uuid.uuid4().hex}" if n else None
        if folder:
            new.write.parquet(f"{self.path}/data/{folder}")
        self._append(entries, {"writer": writer, "batch": batch_id, "folder": folder, "lo": self._plain(lo), "hi": self._plain(hi), "nulls": nulls, "compared": len(near)})
        return folder

    @staticmethod
    def _plain(v):
        """A key as JSON has it; other kinds than numbers and texts by their ISO form, which keeps their order."""
        return v if v is None or isinstance(v, (int, float, str)) else v.isoformat() if hasattr(v, "isoformat") else str(v)

    def read(self, schema) -> DataFrame:
        """All committed rows."""
        folders = [f"{self.path}/data/{e['folder']}" for e in self.entries() if e["folder"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """A batch sink; ``writer`` names the stream, as batch ids are its own."""

        def run(batch: DataFrame, batch_id: int) -> None:
            self.write(batch, writer, batch_id)

        return run
