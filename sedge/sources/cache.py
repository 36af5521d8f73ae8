"""Results that are kept under what they were made from: a name, its parameters, and the set of ids they hold.

An entry is a folder named by a digest of name and parameters, with versions of the rows as Parquet and a file that says
which of them holds. Whether it still fits is told by its ids: their number and the sum and exclusive or of their
hashes, which do not depend on order or partitions and come from one aggregation. A version is written in full before
that file is replaced, in one move, so a failed job changes nothing; the version before is kept until the next, so what
reads it may end.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def id_digest(rows: DataFrame, key: str) -> str:
    """Of the rows' ids, in any order; an id that is there twice is not the same as once."""
    h = F.xxhash64(F.col(key).cast("string"))
    row = rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x")
    ).first()
    return f"{row.n}-{int(row.s)}-{row.x}"


class Cache:
    """Entries under one folder of a shared store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file_system(self, path: str):
        own = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return own, own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str, parameters: dict) -> str:
        """The folder of an entry. Parameters in any order give the same."""
        text = json.dumps([name, parameters], sort_keys=True, default=str)
        return f"{self.root}/{name}-{hashlib.sha256(text.encode()).hexdigest()[:32]}"

    def about(self, name: str, parameters: dict) -> dict | None:
        """What is known of an entry; None if there is none."""
        path = f"{self.path(name, parameters)}/about.json"
        own, fs = self._file_system(path)
        return json.loads(self.spark.read.text(path).first()[0]) if fs.exists(own) else None

    def load(self, name: str, parameters: dict, ids: DataFrame | None = None, key: str = "id") -> DataFrame | None:
        """The rows of an entry; None if there is none, or if it was made for other ids."""
        known = self.about(name, parameters)
        if known is None or (ids is not None and known["ids"] != id_digest(ids, key)):
            return None
        return self.spark.read.parquet(f"{self.path(name, parameters)}/{known['version']}")

    def save(self, rows: DataFrame, name: str, parameters: dict, ids: DataFrame, key: str = "id", more: dict | None = None) -> DataFrame:
        """Write an entry in place of any before it, and read it."""
        path, before = self.path(name, parameters), self.about(name, parameters)
        version = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/{version}")
        about = {"name": name, "parameters": parameters, "ids": id_digest(ids, key), "version": version, **(more or {})}
        self._replace(f"{path}/about.json", json.dumps(about, sort_keys=True, default=str))
        kept = {version, before and before["version"]}
        own, fs = self._file_system(path)
        for status in fs.listStatus(own):
            if status.getPath().getName().startswith("rows-") and status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)
        return self.spark.read.parquet(f"{path}/{version}")

    def _replace(self, path: str, text: str) -> None:
        """Write a file beside its place and move it there, over any before it."""
        fresh, fs = self._file_system(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(fresh)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        over = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(over, 1)
        how[0] = over.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(fresh, self._file_system(path)[0], how)

    def get(
        self, name: str, parameters: dict, ids: DataFrame, make: Callable[[], DataFrame], key: str = "id", anew: bool = False
    ) -> tuple[DataFrame, bool]:
        """The rows of an entry and whether they were there: made and saved if there is none for these ids, or if asked anew."""
        found = None if anew else self.load(name, parameters, ids, key)
        return (found, True) if found is not None else (self.save(make(), name, parameters, ids, key), False)

    def entries(self) -> list[dict]:
        """What is known of all entries, in order of their folders."""
        own, fs = self._file_system(self.root)
        if not fs.exists(own):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(own))
        texts = [f"{self.root}/{n}/about.json" for n in names if fs.exists(self._file_system(f"{self.root}/{n}/about.json")[0])]
        return [json.loads(self.spark.read.text(t).first()[0]) for t in texts]

    def drop(self, name: str, parameters: dict) -> bool:
        own, fs = self._file_system(self.path(name, parameters))
        return fs.delete(own, True)
