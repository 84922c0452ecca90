"""Persistent tables of signed counts on a shared path, in versions.

``path/datos-N/particion=K`` holds the partitions version N wrote, ``path/version-N``
says which version of every partition is in force and which deltas are in it. A merge
reads and writes only the partitions its delta touches; the version exists once its
manifest does, so a merge that fails leaves the state as it was and can be run again.
Old versions stay readable until ``drop_before`` removes what no kept version uses.

Keys are hash-partitioned; the number of partitions follows the size of the table.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

#: Rows of a partition aimed at; the table is dealt anew when its partitions hold four times as many.
PARTITION_ROWS = 2_000_000
#: Versions a table may be spread over before a merge rewrites all of it.
MOST_VERSIONS = 16

_MANIFEST = "particion int, version int, filas long, lote string"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions under a path, oldest first."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return []
    found = [re.fullmatch(r"version-(\d+)", s.getPath().getName()) for s in fs.listStatus(where)]
    return sorted(int(m[1]) for m in found if m and fs.exists(_files(spark, f"{path}/{m[0]}/_SUCCESS")[1]))


@dataclass(frozen=True)
class Counts:
    """A version of a table ``keys…, sums…``; version -1 is the empty table."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    version: int = -1
    #: Version in force of every partition, their rows, and the deltas merged so far.
    parts: tuple[int, ...] = ()
    sizes: tuple[int, ...] = ()
    batches: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def load(cls, spark: SparkSession, path: str | None, schema: str, keys: tuple[str, ...], version: int | None = None) -> Counts:
        """The last complete version (or the one asked for) under ``path``; without a path an empty table in the scratch folder."""
        if path is None:
            return cls(spark, scratch_path(spark, f"counts-{uuid.uuid4().hex[:12]}"), schema, keys)
        known = versions(spark, path)
        if version is not None and version not in known:
            raise ValueError(f"no version {version} under {path}")
        if not known:
            return cls(spark, path, schema, keys)
        version = known[-1] if version is None else version
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/version-{version}").collect()  # one row a partition and delta
        parts = sorted((r for r in rows if r.lote is None), key=lambda r: r.particion)
        return cls(spark, path, schema, keys, version, tuple(r.version for r in parts), tuple(r.filas for r in parts), frozenset(r.lote for r in rows if r.lote is not None))

    def _rows(self, wanted: set[int] | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], f"{self.schema}, particion int")
        for v in sorted({v for k, v in enumerate(self.parts) if v >= 0 and (wanted is None or k in wanted)}):
            held = [k for k, x in enumerate(self.parts) if x == v and (wanted is None or k in wanted)]
            out = out.unionByName(self.spark.read.schema(f"{self.schema}, particion int").parquet(f"{self.path}/datos-{v}").where(F.col("particion").isin(held)))
        return out

    def read(self) -> DataFrame:
        """All rows of the version."""
        return self._rows().drop("particion")

    def merge(self, delta: DataFrame, positive: str, batch: str | None = None) -> Counts:
        """The next version: signed ``keys…, sums…`` added to the table; rows whose ``positive`` sum is not above 0 leave.

        A ``batch`` that is in the table already changes nothing.
        """
        if batch is not None and batch in self.batches:
            return self
        sums = [c for c in delta.columns if c not in self.keys]
        delta = materialize(delta.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in sums]), "delta")
        n, version = sum(self.sizes) + delta.count(), self.version + 1
        count = len(self.parts)
        anew = not count or n > 4 * PARTITION_ROWS * count or len(set(self.parts)) >= MOST_VERSIONS
        if anew:
            count = max(1, math.ceil(n / PARTITION_ROWS))
        place = F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int")
        delta = delta.withColumn("particion", place)
        touched = set(range(count)) if anew else {r.particion for r in delta.select("particion").distinct().collect()}
        old = self.read().withColumn("particion", place) if anew else self._rows(touched)
        merged = old.unionByName(delta).repartition(max(1, min(count, len(touched))), "particion").groupBy("particion", *self.keys).agg(*[F.sum(c).alias(c) for c in sums])
        target = f"{self.path}/datos-{version}"
        merged.where(F.col(positive) > 0).write.mode("overwrite").partitionBy("particion").parquet(target)
        written = self.spark.read.schema(f"{self.schema}, particion int").parquet(target)
        sizes = dict(map(tuple, written.groupBy("particion").agg(F.count("*")).collect()))
        parts = [(version if sizes.get(k) else -1) if k in touched else self.parts[k] for k in range(count)]
        rows = [(k, v, sizes.get(k, 0) if k in touched else self.sizes[k], None) for k, v in enumerate(parts)]
        batches = self.batches | ({batch} if batch is not None else set())
        self.spark.createDataFrame(rows + [(None, None, None, b) for b in sorted(batches)], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version-{version}")
        return Counts(self.spark, self.path, self.schema, self.keys, version, tuple(parts), tuple(r[2] for r in rows), batches)

    def drop_before(self) -> None:
        """Remove the older versions and the partitions only they use."""
        used = set(self.parts)
        for v in range(self.version):
            for name, gone in ((f"version-{v}", True), (f"datos-{v}", v not in used)):
                fs, where = _files(self.spark, f"{self.path}/{name}")
                if gone and fs.exists(where):
                    fs.delete(where, True)
