"""Streaming forms: arrivals decided batch by batch, and the audit log counted over time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store

_ROW = "hash_url string, hash_contenido string, ruta_relativa string, fecha_revisitacion timestamp"


@dataclass
class StoreStream:
    """``foreachBatch`` sink that keeps the document store under ``root``, a folder all executors share.

    The store is dealt to ``buckets`` by the hash of the address. Every batch decides its arrivals
    against the last state, then writes the decisions and the buckets it changed into folders of its
    number; of every bucket the last complete folder is in force. A batch that is run again after a
    failure overwrites its own folders and reads those before it, so the outcome is exactly-once.
    """

    spark: SparkSession
    root: str
    buckets: int = 64
    decided: list[int] = field(default_factory=list)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("hash_url"), F.lit(self.buckets)).cast("int")

    def _names(self, path: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def state(self, before: int | None = None) -> DataFrame:
        """Stored rows after the last batch (of those before ``before``)."""
        batches = sorted(int(n.removeprefix("state-")) for n in self._names(self.root) if n.startswith("state-"))
        held: dict[int, int] = {}
        for b in batches:
            names = self._names(f"{self.root}/state-{b}") if before is None or b < before else []
            if "_SUCCESS" in names:
                held |= {int(n.removeprefix("cubo=")): b for n in names if n.startswith("cubo=")}
        out = self.spark.createDataFrame([], _ROW)
        for b in sorted(set(held.values())):
            rows = self.spark.read.schema(f"{_ROW}, cubo int").parquet(f"{self.root}/state-{b}")
            out = out.unionByName(rows.where(F.col("cubo").isin([k for k, v in held.items() if v == b])).drop("cubo"))
        return out

    def __call__(self, batch: DataFrame, number: int) -> None:
        """batch: secuencia, hash_url, hash_contenido, ruta_relativa, fecha (arrival time)."""
        held = self.state(number)
        now = batch.agg(F.max("fecha").alias("t")).first().t
        if now is None:
            return
        store.decide(batch, held, F.lit(now)).write.mode("overwrite").parquet(f"{self.root}/decisions-{number}")
        verdicts = self.spark.read.parquet(f"{self.root}/decisions-{number}")
        due = F.lit(now) + F.expr(f"INTERVAL {store.REVISIT_DAYS} DAYS")
        kept = batch.join(verdicts.where(F.col("accion").isin(store.STORED, store.REVISITED)), "secuencia").select("hash_url", "hash_contenido", "ruta_relativa", due.alias("fecha_revisitacion"))
        touched = [r.cubo for r in kept.select(self._bucket().alias("cubo")).distinct().collect()]  # at most ``buckets``
        old = held.where(self._bucket().isin(touched)).join(kept.select("hash_url"), "hash_url", "left_anti")
        rows = old.unionByName(kept).withColumn("cubo", self._bucket())
        rows.repartition(max(1, len(touched)), "cubo").write.mode("overwrite").partitionBy("cubo").parquet(f"{self.root}/state-{number}")
        self.decided.append(number)


def action_counts(log: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """``inicio, dominio, accion, n`` per window of a (streaming) audit log; rows later than ``late`` are left out."""
    rows = log.withWatermark("instante", late)
    action = F.upper(F.trim("accion")).alias("accion")
    counts = rows.groupBy(F.window("instante", width).alias("w"), F.lower(F.trim("dominio")).alias("dominio"), action).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("inicio"), "dominio", "accion", "n")
