"""A table with one row per key, kept up to date by merges that rewrite only the buckets they touch.

Layout under the table's folder::

    data/version=<n>/bucket=<b>/   rows of one bucket as of version n
    versions/version=<n>/          where the rows of each bucket lie: (bucket, at), one row per bucket that has any

A version counts once its ``versions`` folder is complete, so readers see all of a merge or nothing of it. Writers come one at a time, such as the
micro-batches of one stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACES = "bucket int, at bigint"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _numbered(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete ``version=<n>`` folders of ``folder``, ascending."""
    fs, target = _file_system(spark, folder)
    if not fs.exists(target):
        return []
    found = []
    for status in fs.listStatus(target):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class KeyedTable:
    """One row per key: the largest by ``order``. The number of buckets must stay what it was when the table was first written.

    A merge reads and writes the buckets that have new rows, so its cost follows those; a reader scans one row per key.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path, key, list(order), buckets

    def version(self, before: int | None = None) -> int | None:
        """The newest complete version, or the newest one before ``before``; None if there is none."""
        found = [n for n in _numbered(self.spark, f"{self.path}/versions") if before is None or n < before]
        return found[-1] if found else None

    def places(self, version: int | None) -> dict[int, int]:
        """Bucket to the version that wrote it last. There are ``buckets`` of them at most."""
        if version is None:
            return {}
        rows = self.spark.read.schema(_PLACES).parquet(f"{self.path}/versions/version={version}").collect()
        return {r.bucket: r.at for r in rows}

    def _rows(self, places: dict[int, int], schema) -> DataFrame:
        paths = [f"{self.path}/data/version={at}/bucket={b}" for b, at in sorted(places.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All keys as of ``version`` (the newest one)."""
        return self._rows(self.places(self.version() if version is None else version), schema)

    def merge(self, rows: DataFrame, version: int) -> None:
        """Merge new rows as ``version``. The same version again does the same again, from the version before it, whatever has been written of it."""
        fields = [self.key, *[c for c in rows.columns if c != self.key]]
        rest = [c for c in fields if c != self.key and c not in self.order]
        best = F.max(F.struct(*self.order, *rest)).alias("_best")

        def last(df: DataFrame) -> DataFrame:
            return df.groupBy(self.key).agg(best).select(self.key, "_best.*").select(*fields)

        new = last(rows.where(F.col(self.key).isNotNull())).withColumn("bucket", bucket_of(self.key, self.buckets))
        places = self.places(self.version(before=version))
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        old = self._rows({b: places[b] for b in touched if b in places}, rows.select(*fields).schema)
        merged = last(old.unionByName(new.drop("bucket"))).withColumn("bucket", bucket_of(self.key, self.buckets))
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        places.update(dict.fromkeys(touched, version))
        table = self.spark.createDataFrame(sorted(places.items()), _PLACES).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")

    def drop_before(self, version: int) -> int:
        """Delete what only versions before ``version`` need, and those versions. Returns the number of folders deleted."""
        live = {(b, at) for b, at in self.places(version).items()}
        for n in _numbered(self.spark, f"{self.path}/versions"):
            if n > version:
                live |= set(self.places(n).items())
        gone = 0
        for n in _numbered(self.spark, f"{self.path}/versions"):
            if n >= version:
                continue
            fs, folder = _file_system(self.spark, f"{self.path}/data/version={n}")
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                name = status.getPath().getName()
                if name.startswith("bucket=") and (int(name.split("=")[1]), n) not in live:
                    gone += bool(fs.delete(status.getPath(), True))
            fs, old = _file_system(self.spark, f"{self.path}/versions/version={n}")
            gone += bool(fs.delete(old, True))
        return gone
