"""Append-only Parquet tables whose batches count once (K2, K3, K4, K5, U2, ST-CNT, ST-LOG).

A batch is written to a folder of its own and becomes part of the table when its marker file is created, which
the file system does at most once. So half a write is never read; writing a batch again after its commit changes
nothing, whether a streaming query replays it or a job is retried; and of two writers of one batch one wins.
A reader lists the markers once and reads those folders: a snapshot that later commits do not change.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BatchTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _fs(self):
        return self._hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _marker(self, batch: str):
        return self._hadoop.Path(f"{self.path}/commits/{batch}")

    def is_committed(self, batch: str) -> bool:
        return self._fs().exists(self._marker(batch))

    def snapshot(self) -> dict[str, dict]:
        """What each committed batch says of itself, by batch, in order of commit."""
        fs, root = self._fs(), self._hadoop.Path(f"{self.path}/commits")
        if not fs.exists(root):
            return {}
        found = {}
        for status in fs.listStatus(root):
            stream = fs.open(status.getPath())
            try:
                raw = bytes(stream.readAllBytes())
            finally:
                stream.close()
            if raw:  # an empty marker: its writer was stopped in between, see ``commit``
                found[status.getPath().getName()] = json.loads(raw.decode())
        return dict(sorted(found.items(), key=lambda x: (x[1]["order"], x[0])))

    def append(self, df: DataFrame, batch: str | int, **about) -> bool:
        """Add ``df`` as ``batch``; False, and nothing written, if that batch is part of the table already."""
        if self.is_committed(str(batch)):
            return False
        return self.commit(self.stage(df), batch, **about)

    def stage(self, df: DataFrame) -> str:
        """Write rows to a folder that no reader sees yet."""
        folder = f"parts/{uuid.uuid4().hex}"
        df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, folder: str, batch: str | int, replaces: list[str] = (), **about) -> bool:
        """Make a staged folder part of the table, in place of the batches ``replaces``.

        The marker is written under another name and then renamed, so it appears whole or not at all.
        """
        fs, marker = self._fs(), self._marker(str(batch))
        if fs.exists(marker):
            return False
        known = self.snapshot()
        body = {"folder": folder, "order": 1 + max((m["order"] for m in known.values()), default=0),
                "replaces": list(replaces), **about}
        draft = self._hadoop.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        fs.mkdirs(marker.getParent())
        return bool(not fs.exists(marker) and fs.rename(draft, marker))

    def folders(self, snapshot: dict[str, dict] | None = None) -> list[str]:
        """The folders of a snapshot (now, if none is given) without the batches that others replaced."""
        known = self.snapshot() if snapshot is None else snapshot
        gone = {b for m in known.values() for b in m["replaces"]}
        return [f"{self.path}/{m['folder']}" for b, m in known.items() if b not in gone]

    def read(self, snapshot: dict[str, dict] | None = None) -> DataFrame:
        found = self.folders(snapshot)
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*found)


def insert_new(table: BatchTable, rows: DataFrame, key: list[str], order: list[str], batch: str | int) -> bool:
    """Add, as one batch, the rows whose key is not in the table; of rows with one key the first by ``order``.

    Keys are compared null-safely. A retry after a commit adds nothing (its batch is there), and a retry
    after half a write starts from the same table, so the outcome is that of one successful run.
    """
    if table.is_committed(str(batch)):
        return False
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rows.columns if c not in order])
    firsts = rows.groupBy(*key).agg(F.min(packed).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in rows.columns])
    known = table.read().select(*[F.col(c).alias(f"_known_{c}") for c in key]).distinct()
    same = None
    for c in key:
        part = F.col(c).eqNullSafe(F.col(f"_known_{c}"))
        same = part if same is None else same & part
    return table.append(firsts.join(known, same, "left_anti"), batch)
