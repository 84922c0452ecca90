"""Politeness over a fetch log: adaptive delay per host, retries, size cap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranges

# FIXED VALUES: bounds of the delay in seconds, codes worth a retry, retries, size cap.
MIN_DELAY, MAX_DELAY = 0.75, 5.0
RETRY_CODES = (429, 500, 502, 503, 504, 522, 524)
RETRIES = 3
MAX_BODY = 5 * 1024 * 1024
# FIXED VALUES: fetches of a host at a time, and the seconds one may take.
MAX_ACTIVE = 4
TIMEOUT = 45


def _compose(f: Column, g: Column) -> Column:
    """g after f, for maps d -> clamp(a * d + b, lo, hi) with a >= 0; such maps are closed under composition."""
    clamp = lambda x: F.least(g["hi"], F.greatest(g["lo"], x))
    return F.struct((f["a"] * g["a"]).alias("a"), (f["b"] * g["a"] + g["b"]).alias("b"), clamp(f["lo"] * g["a"] + g["b"]).alias("lo"), clamp(f["hi"] * g["a"] + g["b"]).alias("hi"))


def adaptive_delay(log: DataFrame) -> DataFrame:
    """``dominio, demora, respuestas``: the delay a host has after all its answers, in order of ``instante, id``.

    log: dominio, id, instante, tiempo_respuesta_ms, codigo_http. One answer maps the
    delay d to clamp((d + target) / 2), target being 2 d in trouble, else half the
    latency. The answers are dealt to ranges of (host, time); the maps of one hour in one
    range are composed first, then those, so that no host is ever folded as one group.
    """
    trouble = F.coalesce(F.col("codigo_http").isin(*RETRY_CODES), F.lit(False))
    step = F.struct(F.when(trouble, 1.5).otherwise(0.5).alias("a"), F.when(trouble, 0.0).otherwise(F.col("tiempo_respuesta_ms") / 4000.0).alias("b"), F.lit(MIN_DELAY).alias("lo"), F.lit(MAX_DELAY).alias("hi"))
    unit = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    known = log.where(F.col("dominio").isNotNull() & F.col("tiempo_respuesta_ms").isNotNull())
    rows = ranges(known.select("dominio", "instante", "id", step.alias("f")), "dominio", "instante", "id").withColumn("hora", F.date_trunc("hour", "instante"))
    fold = lambda order: F.aggregate(F.array_sort(F.collect_list(F.struct(order.alias("orden"), "f"))), unit, lambda acc, x: _compose(acc, x["f"]))
    pieces = rows.groupBy("dominio", "parte_", "hora").agg(fold(F.struct("instante", "id")).alias("f"), F.count("*").alias("n"))
    hosts = pieces.groupBy("dominio").agg(fold(F.struct("parte_", "hora")).alias("f"), F.sum("n").alias("respuestas"))
    value = F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.col("f.a") * MIN_DELAY + F.col("f.b")))
    return hosts.select("dominio", value.alias("demora"), "respuestas")


def retries(log: DataFrame) -> DataFrame:
    """``id, url_destino, intento, resultado, espera_s`` per attempt; the attempts of one fetch fall on one day.

    A retryable answer (or none) is ``reintento`` up to RETRIES times in a row, with
    waits of 2, 4, 8 s, then ``agotado``; other errors are ``definitivo``, answers ``ok``.
    """
    again = F.col("codigo_http").isNull() | F.col("codigo_http").isin(*RETRY_CODES)
    key = ["url_destino", "dia"]
    # ranges of (address, time): an address with very many answers is split, and what a range leaves open is handed on
    rows = ranges(log.withColumn("dia", F.to_date("instante")), "url_destino", "dia", "instante", "id")
    local = Window.partitionBy("parte_", *key).orderBy("instante", "id")
    rows = rows.withColumn("racha", F.coalesce(F.sum((~again).cast("int")).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("intento", F.row_number().over(Window.partitionBy("parte_", *key, "racha").orderBy("instante", "id")))
    groups = rows.groupBy("parte_", *key).agg(F.sum((~again).cast("int")).alias("fines"), F.max_by(F.when(again, F.col("intento")).otherwise(0), F.struct("instante", "id")).alias("abierta"))
    order = F.struct(F.col("url_destino").isNotNull(), "url_destino", "dia")
    ends = groups.groupBy("parte_").agg(F.min_by(F.struct(*key, "fines"), order).alias("a"), F.max_by(F.struct(*key, "fines", "abierta"), order).alias("b"), F.count("*").alias("n"))
    carried, held = [], None  # one row a range
    for r in sorted(ends.collect(), key=lambda r: r.parte_):
        goes_on = held is not None and tuple(r.a)[:2] == held[:2]
        if goes_on and held[2]:
            carried.append((r.parte_, r.a.url_destino, r.a.dia, held[2]))
        whole = r.n == 1 and goes_on and not r.b.fines
        held = (*tuple(r.b)[:2], r.b.abierta + (held[2] if whole else 0))
    before = log.sparkSession.createDataFrame(carried, "p_ int, u_ string, d_ date, antes long")
    met = (F.col("parte_") == F.col("p_")) & F.col("url_destino").eqNullSafe(F.col("u_")) & F.col("dia").eqNullSafe(F.col("d_")) & (F.col("racha") == 0)
    rows = rows.join(F.broadcast(before), met, "left").withColumn("intento", (F.col("intento") + F.coalesce("antes", F.lit(0))).cast("int"))
    result = F.when(~again & (F.col("codigo_http") >= 400), "definitivo").when(~again, "ok").when(F.col("intento") <= RETRIES, "reintento").otherwise("agotado")
    return rows.select("id", "url_destino", "intento", result.alias("resultado"), F.when(result == "reintento", F.pow(F.lit(2.0), F.col("intento")).cast("int")).alias("espera_s"))


def slots(log: DataFrame, delay: float = MIN_DELAY) -> DataFrame:
    """``id, dominio, llegada, turno, activas, libre`` (times in microseconds): when each fetch of a host may start.

    log: dominio, id, instante, tiempo_respuesta_ms. Fetches start in order of ``instante, id``, at least ``delay``
    apart: a start is the running maximum of arrivals less the delays before them, taken within ranges of (host,
    time) and carried over. ``activas`` counts the fetches of the host still running then (TIMEOUT at most each),
    ``libre`` whether they leave a slot. Rows without a host or a time are left out.
    """
    step = int(delay * 1e6)
    known = log.where(F.col("dominio").isNotNull() & F.col("instante").isNotNull())
    lasts = F.round(F.least(F.lit(TIMEOUT * 1e3), F.greatest(F.lit(0.0), F.coalesce("tiempo_respuesta_ms", F.lit(0.0)))) * 1e3).cast("long")
    rows = ranges(known.select("id", "dominio", "instante", F.unix_micros("instante").alias("llegada"), lasts.alias("dura")), "dominio", "instante", "id")
    local = Window.partitionBy("parte_", "dominio").orderBy("instante", "id")
    rows = rows.withColumn("k", F.row_number().over(local).cast("long") - 1).withColumn("tope", F.max(F.col("llegada") - F.col("k") * step).over(local))
    sums = rows.groupBy("parte_", "dominio").agg(F.count("*").alias("n"), F.max("tope").alias("m"))
    earlier = Window.partitionBy("dominio").orderBy("parte_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("antes", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    sums = sums.withColumn("previo", F.max(F.col("m") - F.col("antes") * step).over(earlier)).select("parte_", "dominio", "antes", "previo")
    placed = rows.join(sums, ["parte_", "dominio"])
    start = F.greatest(F.col("tope") - F.col("antes") * step, "previo") + (F.col("k") + F.col("antes")) * step
    placed = placed.select("id", "dominio", "llegada", start.alias("turno"), (start + F.col("dura")).alias("fin"))
    # within an hour a host has a bounded number of starts; those that run on into the next hour are put there, too
    hour = 3_600_000_000
    hours = F.sequence(F.floor(F.col("turno") / hour), F.floor(F.col("fin") / hour))
    seen = placed.withColumn("hora", F.explode(hours)).withColumn("propia", F.floor(F.col("turno") / hour) == F.col("hora"))
    before = Window.partitionBy("dominio", "hora").orderBy("turno").rowsBetween(-math.ceil(TIMEOUT / delay), -1)
    active = F.size(F.filter(F.collect_list("fin").over(before), lambda x: x > F.col("turno")))
    return seen.withColumn("activas", active).where("propia").select("id", "dominio", "llegada", "turno", "activas", (F.col("activas") < MAX_ACTIVE).alias("libre"))


def within_size(body: Column) -> Column:
    return F.coalesce(F.octet_length(body) <= MAX_BODY, F.lit(True))
