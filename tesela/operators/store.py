"""Document store: content identity, arrival decisions, freshness, paths, audit."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import _icu, nfc
from ..session import materialize
from .joins import skew_join
from .ranking import global_position

STORED, REVISITED, SAME_URL, SAME_CONTENT = "ALMACENADO", "REVISITADO", "DUPLICADO_URL", "DUPLICADO_CONTENIDO"
REVISIT_DAYS = 30
#: Blanks within a line, as the content hash sees them.
BLANKS = "[\\t\\x0B\\f\\r \\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def normal_content(text: Column) -> Column:
    """NFC without NUL, plain line ends, single blanks, trimmed lines, at most one empty line in a row."""
    t = F.replace(nfc(text), F.lit("\0"), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, "\\r\\n?", "\n"), BLANKS + "+", " ")
    t = F.regexp_replace(F.regexp_replace(t, " *\\n *", "\n"), "\\n{3,}", "\n\n")
    return F.trim(t, F.lit(" \n"))


def content_hash(text: Column, normalise: bool = True) -> Column:
    return F.sha2(normal_content(text) if normalise else text, 256)


def scan_collection(documentos: DataFrame, texts: DataFrame, limit: int = 0) -> DataFrame:
    """Dense ``doc_id`` in order of id, only for rows with a text; ``limit`` counts before texts are looked for.

    Rows repeated exactly count once. ``texts`` has ``db_id, texto``.
    """
    rows = documentos.dropDuplicates(["id"])
    if limit > 0:
        rows = rows.orderBy("id").limit(limit)
    return global_position(rows.join(texts.select(F.col("db_id").alias("id"), "texto"), "id"), "id", name="doc_id")


#: Open arrivals up to which the rest of a batch is decided in order by one task (hashes and paths: under 100 MB).
ONE_BY_ONE = 200_000


def _simple(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _one_by_one(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrivals in their order: taken if neither address nor content is taken."""
    rows = pd.concat(list(batches))
    order = rows["secuencia"].map(lambda v: tuple(v.values()) if isinstance(v, dict) else v)
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: order.iat[i])]
    urls, contents, taken = set(), set(), []
    for url, content in zip(rows["hash_url"], rows["hash_contenido"]):
        free = url not in urls and content not in contents
        taken.append(free)
        if free:
            urls.add(url)
            contents.add(content)
    yield rows.assign(tomada=taken)


def decide(arrivals: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """``secuencia, accion, ruta_anterior`` for a batch of arrivals against the stored rows.

    arrivals: secuencia, hash_url, hash_contenido, ruta_relativa. stored: hash_url,
    hash_contenido, ruta_relativa, fecha_revisitacion (one row a URL). A known URL that
    is fresh is a duplicate; an expired one is revisited unless the content is stored
    under another URL; a new one is stored unless its content is. Within the batch the
    order counts: in every round the rows that are first of the open ones for both
    their URL and their content are taken, and what conflicts with them is answered,
    until few are open, which one task decides in order. A URL is revisited once a batch; a later row of it is a duplicate.
    """
    arrivals = arrivals.select("secuencia", "hash_url", "hash_contenido", "ruta_relativa")
    s = stored.select("hash_url", F.col("hash_contenido").alias("contenido_viejo"), F.col("ruta_relativa").alias("ruta_vieja"), F.col("fecha_revisitacion").alias("vence"), F.lit(True).alias("hay"))
    # content is "elsewhere" if two URLs hold it, or one other URL does
    holders = stored.groupBy("hash_contenido").agg(F.count_distinct("hash_url").alias("n_url"), F.min("hash_url").alias("una_url"))
    known = arrivals.join(s, "hash_url", "left").join(holders, "hash_contenido", "left")
    fresh = F.col("hay") & F.col("vence").isNotNull() & (F.col("vence") > now)
    elsewhere = F.coalesce((F.col("n_url") > 1) | (F.col("una_url") != F.col("hash_url")), F.lit(False))
    first = materialize(known.select("secuencia", "hash_url", "hash_contenido", "ruta_relativa", "ruta_vieja", F.coalesce("hay", F.lit(False)).alias("hay"), F.when(fresh, SAME_URL).when(elsewhere, SAME_CONTENT).alias("accion")), "arrivals")
    known_url = first.where(F.col("accion") == SAME_URL).select("secuencia", F.lit(SAME_URL).alias("accion"), F.lit(None).cast("string").alias("ruta_anterior"))
    refused = [first.where(F.col("accion") == SAME_CONTENT).select("secuencia", "hash_url")]
    accepted = []
    rest = first.where(F.col("accion").isNull()).drop("accion")
    while (n := rest.count()) > ONE_BY_ONE:
        by_url = rest.groupBy("hash_url").agg(F.min("secuencia").alias("p_url"), F.count("*").alias("n_url"))
        by_content = rest.groupBy("hash_contenido").agg(F.min("secuencia").alias("p_contenido"), F.count("*").alias("n_contenido"))
        ranked = skew_join(skew_join(rest, by_url, "hash_url", "n_url", n, "secuencia"), by_content, "hash_contenido", "n_contenido", n, "secuencia")
        taken = materialize(ranked.where((F.col("secuencia") == F.col("p_url")) & (F.col("secuencia") == F.col("p_contenido"))).drop("p_url", "p_contenido", "n_url", "n_contenido"), "taken")
        accepted.append(taken)
        urls = taken.select("hash_url", F.lit(True).alias("url_tomada"))
        contents = taken.select("hash_contenido", F.lit(True).alias("contenido_tomado"))
        hit = rest.join(taken.select("secuencia"), "secuencia", "left_anti").join(urls, "hash_url", "left").join(contents, "hash_contenido", "left")
        answered = materialize(hit.withColumn("fuera", F.coalesce("url_tomada", "contenido_tomado", F.lit(False))).drop("url_tomada", "contenido_tomado"), "answered")
        refused.append(answered.where("fuera").select("secuencia", "hash_url"))
        rest = answered.where(~F.col("fuera")).drop("fuera")
    if n:
        settled = materialize(rest.coalesce(1).mapInPandas(_one_by_one, f"{_simple(rest)}, tomada boolean"), "one-by-one")
        accepted.append(settled.where("tomada").drop("tomada"))
        refused.append(settled.where(~F.col("tomada")).select("secuencia", "hash_url"))
    out = known_url
    owners = None
    for taken in accepted:
        old = F.when(F.col("hay") & (F.col("ruta_vieja") != F.col("ruta_relativa")), F.col("ruta_vieja"))
        out = out.unionByName(taken.select("secuencia", F.when(F.col("hay"), REVISITED).otherwise(STORED).alias("accion"), old.alias("ruta_anterior")))
        own = taken.select("hash_url", F.col("secuencia").alias("s_url"))
        owners = own if owners is None else owners.unionByName(own)
    lost = refused[0]
    for more in refused[1:]:
        lost = lost.unionByName(more)
    # the address is looked up before the content: whose address was taken by then is a duplicate of that
    label = F.when(F.col("s_url") < F.col("secuencia"), SAME_URL).otherwise(SAME_CONTENT)
    lost = lost.join(owners, "hash_url", "left").select("secuencia", label.alias("accion")) if owners is not None else lost.select("secuencia", F.lit(SAME_CONTENT).alias("accion"))
    return out.unionByName(lost.withColumn("ruta_anterior", F.lit(None).cast("string")))


def needs_visit(keys: DataFrame, documentos: DataFrame, now: Column) -> DataFrame:
    """``hash_url, vencida`` of the keys: unknown, never dated or due."""
    due = documentos.groupBy("hash_url").agg(F.max("fecha_revisitacion").alias("vence"))
    return keys.select("hash_url").distinct().join(due, "hash_url", "left").select("hash_url", (F.col("vence").isNull() | (F.col("vence") <= now)).alias("vencida"))


def safe_component(value: Column, default: str = "documento") -> Column:
    """Folder name of ASCII letters, digits and ``._-``."""
    ascii_only = F.regexp_replace(_icu(value, "decompose", True), "[^\\x00-\\x7F]", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(ascii_only, "[^A-Za-z0-9._-]", "-"), "-+", "-"), "\\.{2,}", ".")
    t = F.rtrim(F.substring(F.trim(t, F.lit("._-")), 1, 120), F.lit("._-"))
    return F.when(t == "", default).otherwise(t)


def document_path(domain: Column, category: Column, digest: Column) -> Column:
    """``domain/category/hh/hash.txt``; null unless the hash is a SHA-256."""
    d = F.lower(F.trim(digest))
    path = F.concat_ws("/", safe_component(domain), safe_component(category), F.substring(d, 1, 2), F.concat(d, F.lit(".txt")))
    return F.when(d.rlike("^[0-9a-f]{64}$"), path)


def audit(log: DataFrame) -> DataFrame:
    """Rows as the audit log takes them: no blank domain, no negative time, actions trimmed in upper case."""
    domain = F.coalesce(F.col("dominio"), F.lit(""))
    return log.select("id", "instante", F.when(domain == "", "(desconocido)").otherwise(domain).alias("dominio"), "url_origen", "url_destino", F.greatest(F.lit(0.0), F.coalesce(F.col("tiempo_respuesta_ms"), F.lit(0.0))).alias("tiempo_respuesta_ms"), "codigo_http", F.upper(F.trim("accion")).alias("accion"))


def summary(documentos: DataFrame, log: DataFrame) -> DataFrame:
    docs = documentos.agg(F.count("*").alias("documentos"), F.coalesce(F.sum("tamano_texto_bytes"), F.lit(0)).alias("bytes"))
    return docs.crossJoin(log.agg(F.count("*").alias("bitacora")))


#: Tables of a store. FIXED VALUES.
SCHEMA = {
    "documentos": "id long, url string, hash_url string, dominio string, categoria string, ruta_relativa string, tamano_texto_bytes long, hash_contenido string, codigo_http int, profundidad int, fecha_descarga timestamp, fecha_revisitacion timestamp",
    "bitacora_recorrido": "id long, instante timestamp, dominio string, url_origen string, url_destino string, tiempo_respuesta_ms double, codigo_http int, accion string",
    "frontera": "id long, hash_url string, url string, profundidad int, prioridad double, url_origen string, estado string, intentos int, actualizada_en timestamp",
    "migraciones": "version int, nombre string, aplicada_en timestamp",
}
SCHEMA_VERSION = (2, "frontera")


def bootstrap(spark: SparkSession, root: str) -> DataFrame:
    """``tabla, columnas, creada``: the tables of a store under ``root``, made where they are missing; running it again changes nothing."""
    out = []
    for name, schema in SCHEMA.items():
        path = f"{root}/{name}"
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        missing = not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        if missing:
            rows = spark.createDataFrame([], schema)
            if name == "migraciones":
                rows = spark.createDataFrame([SCHEMA_VERSION], "version int, nombre string").select("version", "nombre", F.current_timestamp().alias("aplicada_en"))
            rows.write.mode("overwrite").parquet(path)
        out.append((name, len(spark.read.parquet(path).columns), missing))
    return spark.createDataFrame(out, "tabla string, columnas int, creada boolean")
