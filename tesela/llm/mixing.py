"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length per source. A source's budget is its
weight of the total; it is met by whole repeats of all its documents and, for the
rest, by a bounded knapsack over the length counts. Documents of a length are
then taken in seeded order.

Odd input: null, empty and untokenisable texts (0 tokens) are never chosen; a null
source belongs to no target; sources are compared without case and outer blanks;
a target without documents reaches 0, and the other weights are scaled up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..operators.joins import bounded_join
from .tokens import VOCABULARY, count_tokens

#: Tokens first left to the knapsack, or twice the longest document if that is more; what exceeds them is taken
#: proportionally over the lengths, by cumulative quotas. Where the knapsack cannot fill them it gets four times as many.
RESERVE = 20_000
#: Documents of one length ranked by one task; larger groups are split by the seeded hash.
RANKED = 5_000


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> tuple[int, np.ndarray]:
    """Largest sum of at most ``counts`` of every length that is within the budget, and how many of each make it."""
    take = np.zeros(len(lengths), dtype=np.int64)
    origin = np.full(budget + 1, -1, dtype=np.int32)
    origin[0] = 0
    pieces: list[tuple[int, int]] = [(0, 0)]
    for i in np.argsort(lengths, kind="stable"):
        left, step = int(min(counts[i], budget // max(1, lengths[i]))), 1
        while left > 0 and origin[budget] < 0:
            q = min(step, left)
            size = int(lengths[i]) * q
            if size <= budget:
                fresh = (origin[: budget + 1 - size] >= 0) & (origin[size:] < 0)
                pieces.append((int(i), q))
                origin[size:][fresh] = len(pieces) - 1
            left, step = left - q, step * 2
        if origin[budget] >= 0:
            break
    at = best = int(np.flatnonzero(origin >= 0)[-1])
    while at:
        i, q = pieces[origin[at]]
        take[i] += q
        at -= int(lengths[i]) * q
    return best, take


def quotas(lengths: np.ndarray, counts: np.ndarray, budget: int, start: float) -> np.ndarray:
    """How many of each length to take so that every stretch of lengths gets its share of the budget, however few documents a length has.

    Cumulative quotas over the sorted lengths from a start in [0, 1); the sum is within the budget and the longest length.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    order = np.argsort(lengths, kind="stable")
    reached = (np.concatenate([[0], np.cumsum(counts[order])]).astype(object) * budget + int(start * total)) // total
    take[order] = np.diff(reached).astype(np.int64)
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, max_repeats: int, seed: int = 42) -> tuple[int, np.ndarray]:
    """Whole repeats of all documents, and how many of each length to use once more, to come as near to the budget as can be.

    The sum never exceeds the budget. The knapsack first covers the reserve; where it cannot fill
    that, the reserve grows until it can or nothing is left outside, so the sum is the largest there is.
    Lengths are divided by their common divisor, which settles most budgets that cannot be met.
    """
    none = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if not total or budget <= 0:
        return 0, none
    full = min(max_repeats, budget // total)
    rest = budget - full * total
    if full == max_repeats or not rest:
        return full, none
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    lengths, rest = lengths // unit, rest // unit
    start = float(np.random.default_rng(seed).random())
    reserve, spared = max(RESERVE, 2 * int(lengths[counts > 0].max())), 0
    while True:
        # of every length ``spared`` documents of the quota are left to the knapsack as well: a rare length may be what it needs
        fixed = np.maximum(quotas(lengths, counts, rest - reserve, start) - spared, 0) if rest > reserve else none
        open_ = rest - int((lengths * fixed).sum())
        reached, more = knapsack(lengths, counts - fixed, open_)
        if reached == open_ or not fixed.any():
            return full, fixed + more
        reserve, spared = 4 * reserve, 2 * spared + 1


def _source(c):
    return F.lower(F.trim(c))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): ``doc_id, fuente, n_tokens, repeticiones`` and the shares reached per target.

    Without ``total_tokens`` the total is the largest at which every source that has
    documents can reach its share within its repeats.
    """
    counted = materialize(count_tokens(documents.select("doc_id", _source(F.col("source")).alias("fuente"), "text"), ("doc_id", "fuente"), "text", vocabulary).where((F.col("n_tokens") > 0) & F.col("fuente").isNotNull()), "token-counts")
    wanted = targets.where(F.col("fuente").isNotNull()).groupBy(_source(F.col("fuente")).alias("fuente")).agg(F.sum("peso_objetivo").alias("peso_objetivo"), F.max("max_repeticiones").alias("max_repeticiones"))
    lengths = materialize(counted.groupBy("fuente", "n_tokens").agg(F.count("*").alias("n")), "lengths")
    sizes = lengths.groupBy("fuente").agg(F.sum(F.col("n_tokens").cast("long") * F.col("n")).alias("disponible"), F.sum("n").alias("documentos"))
    # one row per target of the mixture table
    plan = [r.asDict() for r in wanted.join(sizes, "fuente", "left").collect()]
    have = [p for p in plan if p["disponible"] and (p["peso_objetivo"] or 0) > 0 and (p["max_repeticiones"] or 0) > 0]
    scale = sum(p["peso_objetivo"] for p in have) or 1.0
    if total_tokens is None:
        total_tokens = int(min((p["max_repeticiones"] * p["disponible"] * scale / p["peso_objetivo"] for p in have), default=0))
    budgets = {p["fuente"]: (int(round(total_tokens * p["peso_objetivo"] / scale)), int(p["max_repeticiones"])) for p in have}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["fuente"].iloc[0]
        if source not in budgets:
            return pdf.iloc[:0].assign(enteras=0, extra=0)[["fuente", "n_tokens", "n", "enteras", "extra"]]
        pdf = pdf.sort_values("n_tokens")
        full, take = fit_budget(pdf["n_tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), *budgets[source], seed)
        return pdf.assign(enteras=full, extra=take)[["fuente", "n_tokens", "n", "enteras", "extra"]]

    quota = materialize(lengths.groupBy("fuente").applyInPandas(fit, "fuente string, n_tokens int, n long, enteras long, extra long"), "quota")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    docs = bounded_join(counted, quota, ["fuente", "n_tokens"], "doc_id").withColumn("orden", order)
    docs = docs.withColumn("cubo", F.pmod(F.col("orden"), F.ceil(F.col("n") / RANKED)).cast("int"))
    group = Window.partitionBy("fuente", "n_tokens").orderBy("cubo").rowsBetween(Window.unboundedPreceding, -1)
    cubes = docs.groupBy("fuente", "n_tokens", "cubo").agg(F.count("*").alias("en_cubo"), F.max("extra").alias("x")).withColumn("antes", F.coalesce(F.sum("en_cubo").over(group), F.lit(0)))
    cubes = cubes.select("fuente", "n_tokens", "cubo", F.greatest(F.lit(0), F.least(F.col("x") - F.col("antes"), F.col("en_cubo"))).alias("cupo"))
    ranked = docs.join(cubes, ["fuente", "n_tokens", "cubo"]).withColumn("puesto", F.row_number().over(Window.partitionBy("fuente", "n_tokens", "cubo").orderBy("orden", "doc_id")))
    chosen = ranked.select("doc_id", "fuente", "n_tokens", (F.col("enteras") + (F.col("puesto") <= F.col("cupo")).cast("long")).cast("int").alias("repeticiones")).where(F.col("repeticiones") > 0)
    used = quota.groupBy("fuente").agg(F.sum(F.col("n_tokens") * (F.col("n") * F.col("enteras") + F.col("extra"))).alias("tokens"))
    everything = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())
    shares = wanted.join(sizes, "fuente", "left").join(used, "fuente", "left").select(
        "fuente", "peso_objetivo", "max_repeticiones", F.coalesce("documentos", F.lit(0)).alias("documentos"), F.coalesce("disponible", F.lit(0)).alias("disponible"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.when(everything > 0, F.coalesce("tokens", F.lit(0)) / everything).otherwise(F.lit(0.0)).alias("proporcion"),
    )
    return chosen, shares


def p9_gaps(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``fuente, objetivo, documentos, cumple, en_limite`` per target: the share wanted of those that can be had, and whether shares and repeats keep to it.

    A share is met if it is off by no more tokens than the longest chosen document of every source has.
    """
    chosen, shares = mixture(documents, targets)
    used = chosen.groupBy("fuente").agg(F.max("repeticiones").alias("mas"), F.max("n_tokens").alias("largo"))
    everywhere = Window.partitionBy()  # one row per target
    usable = (F.col("documentos") > 0) & (F.col("peso_objetivo") > 0) & (F.col("max_repeticiones") > 0)
    weight = F.when(usable, F.col("peso_objetivo")).otherwise(0.0)
    wanted = F.coalesce(weight / F.nullif(F.sum(weight).over(everywhere), F.lit(0.0)), F.lit(0.0))
    gap = F.abs(F.col("proporcion") - F.col("objetivo")) * F.sum("tokens").over(everywhere)
    rows = shares.join(used, "fuente", "left").withColumn("objetivo", wanted).withColumn("cumple", gap <= F.coalesce(F.sum("largo").over(everywhere), F.lit(0)))
    return rows.select("fuente", F.round("objetivo", 9).alias("objetivo"), "documentos", "cumple", F.coalesce(F.col("mas") <= F.col("max_repeticiones"), F.lit(True)).alias("en_limite"))
