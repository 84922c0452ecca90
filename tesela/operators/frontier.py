"""Crawl frontier as keyed state folded from an event log, and level-wise enqueueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..session import materialize
from .joins import skew_join

MAX_ATTEMPTS = 3
MAX_DEPTH = 4
REGISTER, VISITED, FAILED = "registrar", "visitada", "error"


def fold(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """State per key of ``clave, orden, tipo, url, profundidad, url_origen`` events.

    A registration always leaves a row pending with no attempts, so the state is
    decided by what follows the last one: failures are counted, and the last event
    tells the rest. Both steps are plain aggregations, so keys of any size are
    combined before they are moved, and hot keys are split where events meet their last registration. Events of keys never registered change nothing.
    """
    seen = F.col("tipo") == REGISTER
    rows = materialize(events.where(F.col("clave").isNotNull()), "events")
    last = rows.where(seen).groupBy("clave").agg(
        F.max("orden").alias("ultimo"), F.min("orden").alias("primero"), F.max_by("url", "orden").alias("url"), F.max_by("profundidad", "orden").alias("profundidad"),
        F.max_by("url_origen", F.when(F.col("url_origen").isNotNull(), F.col("orden"))).alias("url_origen"),
    )
    others = rows.where(~seen).select("clave", "orden", "tipo")
    since = rows.groupBy("clave").agg(F.max(F.when(seen, F.col("orden"))).alias("ultimo"), F.count("*").alias("n"))
    after = skew_join(others, since, "clave", "n", rows.count(), "orden").where(F.col("orden") > F.col("ultimo"))
    later = after.groupBy("clave").agg(F.sum((F.col("tipo") == FAILED).cast("int")).alias("intentos"), F.max_by("tipo", "orden").alias("fin"))
    attempts = F.coalesce("intentos", F.lit(0)).cast("int")
    state = F.when(F.col("fin").isNull(), "pendiente").when((F.col("fin") == FAILED) & (attempts < max_attempts), "error").otherwise("visitada")
    joined = last.join(later, "clave", "left")
    return joined.select("clave", "url", "profundidad", (-F.col("profundidad").cast("double")).alias("prioridad"), "url_origen", state.alias("estado"), attempts.alias("intentos"), "primero")


def current(frontera: DataFrame) -> DataFrame:
    """Latest state of every id; exact duplicates and older states fall away."""
    cols = [c for c in frontera.columns if c != "id"]
    packed = frontera.groupBy("id").agg(F.max(F.struct("actualizada_en", *[c for c in cols if c != "actualizada_en"])).alias("m"))
    return packed.select("id", *[F.col("m")[c].alias(c) for c in cols])


def eligible(frontera: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Pending rows and failed ones with attempts left; read in order of ``prioridad`` descending, ``id``."""
    open_ = (F.col("estado") == "pendiente") | ((F.col("estado") == "error") & (F.col("intentos") < max_attempts))
    return frontera.where(open_).orderBy(F.desc("prioridad"), "id")


def reconcile(frontera: DataFrame, documentos: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The frontier with fresh eligible rows marked visited; ``descartada`` says which."""
    due = documentos.groupBy("hash_url").agg(F.max("fecha_revisitacion").alias("vence"))
    open_ = (F.col("estado") == "pendiente") | ((F.col("estado") == "error") & (F.col("intentos") < max_attempts))
    fresh = open_ & F.coalesce(F.col("vence") > now, F.lit(False))
    return frontera.join(due, "hash_url", "left").select("id", "hash_url", F.when(fresh, "visitada").otherwise(F.col("estado")).alias("estado"), "intentos", "prioridad", fresh.alias("descartada"))


def crawl(seeds: DataFrame, links: DataFrame, hosts: Column | None = None, max_depth: int = MAX_DEPTH, sizes: DataFrame | None = None, goal: int | None = None) -> DataFrame:
    """``url, profundidad, url_origen``: breadth-first enqueueing over a table of links, level by level.

    seeds: url. links: url, enlace. Each address is enqueued once, at its least depth,
    from its smallest origin; at most ``max_depth`` joins are run. With ``sizes`` (url, bytes)
    and a ``goal`` no further level is entered once the levels so far hold that many bytes.
    """
    ok = urls.admissible(F.col("url"), hosts)
    level = materialize(seeds.select("url").where(F.col("url").isNotNull() & ok).distinct().select("url", F.lit(0).alias("profundidad"), F.lit(None).cast("string").alias("url_origen")), "level")
    out, held = level, 0
    for depth in range(1, max_depth + 1):
        if sizes is not None and goal is not None:
            held += level.join(sizes, "url").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
            if held >= goal:
                break
        found = level.select(F.col("url").alias("url_origen")).join(links.select(F.col("url").alias("url_origen"), F.col("enlace").alias("url")), "url_origen")
        fresh = found.where(F.col("url").isNotNull() & ok).groupBy("url").agg(F.min("url_origen").alias("url_origen")).join(out.select("url"), "url", "left_anti")
        level = materialize(fresh.select("url", F.lit(depth).alias("profundidad"), "url_origen"), "level")
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def page_action() -> Column:
    """What becomes of a fetched page, by the columns permitido, codigo_http, es_html, directivas, es_hub, rechazo, tienda.

    Null where nothing further is recorded (other than 2xx answers, and hub pages).
    """
    forbids = F.array_contains("directivas", "noindex") | F.array_contains("directivas", "none")
    return (
        F.when(~F.col("permitido"), "BLOQUEADO_ROBOTS").when(F.col("codigo_http").isNull() | (F.col("codigo_http") >= 400), "ERROR").when(~F.col("codigo_http").between(200, 299), F.lit(None))
        .when(~F.col("es_html"), "NO_HTML").when(forbids, "NOINDEX").when(F.col("es_hub"), F.lit(None)).when(F.col("rechazo").isNotNull(), "BAJA_DENSIDAD").otherwise(F.col("tienda"))
    )


def follows_links() -> Column:
    return ~(F.array_contains("directivas", "nofollow") | F.array_contains("directivas", "none"))
