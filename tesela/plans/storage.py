"""Queries over URLs, page quality, document store, frontier, acquisition and reports, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import acquisition, frontier, reports, store
from ..session import materialize, scratch_path, table, text_table

Query = Callable[[SparkSession, str], DataFrame]
#: The instant that freshness is judged at.
NOW = "2024-09-01 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW))


def _documents(spark, d):
    return table(spark, d, "documentos").distinct()


def _log(spark, d):
    return table(spark, d, "bitacora_recorrido").dropDuplicates(["id"])


def _targets(spark, d):
    return table(spark, d, "bitacora_recorrido").select("url_destino", "url_origen").select(F.explode(F.array("url_destino", "url_origen")).alias("url")).where(F.col("url").isNotNull()).distinct()


def s1_scan(spark, d):
    return store.scan_collection(table(spark, d, "documentos"), table(spark, d, "coleccion").select("db_id", "texto")).select("doc_id", "id", "hash_url", F.octet_length("texto").alias("bytes"))


def s2_count(spark, d):
    docs = table(spark, d, "documentos").select("id").distinct()
    return docs.agg(F.count("*").alias("total"), F.least(F.count("*"), F.lit(100)).alias("con_limite"))


def s15_hash_bytes(spark, d):
    """32 raw bytes of a hash: hexadecimal is decoded, anything else cut or padded."""
    h = F.trim("hash_url")
    raw = F.when(h.rlike("^[0-9a-fA-F]{64}$"), F.unhex(h)).otherwise(F.substring(F.rpad(F.encode(h, "UTF-8"), 32, F.unhex(F.lit("00"))), 1, 32))
    return _documents(spark, d).select("id", F.hex(raw).alias("bytes"))


def u1_canonical(spark, d):
    return _targets(spark, d).select("url", urls.canonical(F.col("url")).alias("canonica"), urls.url_hash(F.col("url")).alias("huella"))


def u5_tracking(spark, d):
    """Queries of the log's addresses with tracking parameters put in, and taken out again."""
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    dirty = F.concat_ws("&", F.lit("utm_source=feed"), q, F.lit("FBCLID=1"), F.lit("ref=x"))
    return _targets(spark, d).where(q != "").select("url", urls.drop_tracking_parameters(dirty).alias("consulta"))


def u8_hosts(spark, d):
    u = F.col("url")
    return _targets(spark, d).select("url", urls.native_host(u).alias("host"), urls.native_registrable(urls.native_host(u)).alias("registrable"), urls.native_origin(u).alias("origen"), urls.is_http(u).alias("es_http"))


def u9_python_hosts(spark, d):
    u = F.col("url")
    return _targets(spark, d).select("url", urls.host(u).alias("host"), urls.registrable_domain(u).alias("registrable"), urls.origin_host(u).alias("origen"))


def _seed_hosts(spark, d):
    hosts = table(spark, d, "coleccion").select(F.regexp_replace(F.lower(F.trim("dominio")), r"^www\.", "").alias("h")).distinct()
    return hosts.agg(F.array_sort(F.collect_set("h")).alias("hosts"))  # the allowed hosts: a configuration of bounded size


def u12_allowed(spark, d):
    return _targets(spark, d).crossJoin(F.broadcast(_seed_hosts(spark, d))).select("url", urls.allowed_host(urls.native_host(F.col("url")), F.col("hosts")).alias("permitido"))


def _odd_urls(spark, d):
    """The log's addresses plus forms the admission filter must refuse."""
    base = _targets(spark, d)
    odd = base.select(F.explode(F.array(*[F.concat(F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1), F.lit(x)) for x in ("/a.PDF", "/wiki/Talk:X", "/w?action=edit", "/pmwiki/pmwiki.php/YMMV/X", "/wiki/Category:Cine", "/wiki/Cine_(desambiguaci%C3%B3n)", "/ok.html")])).alias("url"))
    return base.unionByName(odd).distinct()


def u13_admission(spark, d):
    return _odd_urls(spark, d).select("url", urls.admissible(F.col("url")).alias("admitida"))


def u14_hubs(spark, d):
    return _odd_urls(spark, d).select("url", urls.is_hub(F.col("url"), F.lit(None).cast("string")).alias("es_hub"))


def _pages(spark, d):
    return text_table(spark, d, "resultado_html")


def h1_parse(spark, d):
    """Pages written out as HTML and read again: text, title, links and directives must come back."""
    p = _pages(spark, d)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.split(esc(F.coalesce("texto", F.lit(""))), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    links = F.array_join(F.transform(F.coalesce("enlaces", F.array().cast("array<string>")), lambda x: F.concat(F.lit("<a href=\""), esc(x), F.lit("#s\">x</a>"))), "")
    page = F.concat(F.lit("<html><head><title>"), esc(F.coalesce("titulo", F.lit(""))), F.lit("</title><meta name=robots content=\""), F.array_join(F.coalesce("directivas_robots", F.array().cast("array<string>")), ", "), F.lit("\"><script>no<p></script></head><body><nav>"), links, F.lit("</nav>"), body, F.lit("</body></html>"))
    r = html.parse_html(page, F.col("url"))
    return p.select("pagina_id", r.alias("r")).select("pagina_id", "r.titulo", F.size("r.enlaces").alias("enlaces"), F.md5("r.texto").alias("texto"), "r.directivas_robots")


def h2_tidy(spark, d):
    return _pages(spark, d).select("pagina_id", F.md5(html.native_tidy(F.col("texto"))).alias("texto"))


def h4_directives(spark, d):
    header = F.array_join(F.coalesce("directivas_robots", F.array().cast("array<string>")), "; ")
    return _pages(spark, d).select("pagina_id", F.array_join(html.native_directives(F.concat(F.upper(header), F.lit(" ,"))), ",").alias("directivas"))


def _quality(spark, d):
    t, title, u = F.col("texto"), F.col("titulo"), F.col("url")
    listed = html.is_list(t, title, u)
    return _pages(spark, d).withColumn("es_lista", listed).withColumn("rechazo", html.rejection(t, F.col("es_lista"), title, u)).withColumn("desambiguacion", html.is_disambiguation(t, title, u))


def h5_h7_quality(spark, d):
    return _quality(spark, d).select("pagina_id", "desambiguacion", "es_lista", "rechazo")


def h7_collection(spark, d):
    none = F.lit(None).cast("string")
    c = text_table(spark, d, "coleccion")
    return c.select("doc_id", html.rejection(F.col("texto"), html.is_list(F.col("texto"), none, F.col("url")), none, F.col("url")).alias("rechazo"))


def h8_responses(spark, d):
    """Typed and decoded answers: every page's text as Latin-1 bytes under a header that says so."""
    body = F.encode(F.regexp_replace(F.coalesce("texto", F.lit("")), r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    header = F.lit("text/html; charset=iso-8859-1")
    return _pages(spark, d).select("pagina_id", html.is_html(header).alias("es_html"), F.md5(html.decode_body(body, header)).alias("texto"))


def d1_content(spark, d):
    return text_table(spark, d, "coleccion").select("doc_id", store.content_hash(F.col("texto")).alias("normal"), store.content_hash(F.col("texto"), False).alias("cruda"))


def d2_raw_hash(spark, d):
    return _targets(spark, d).select("url", urls.url_hash(F.col("url"), False).alias("huella"))


def _arrivals(spark, d):
    return _documents(spark, d).select(F.struct("fecha_descarga", "id").alias("secuencia"), "id", "hash_url", "hash_contenido", "ruta_relativa")


def d3_decisions(spark, d):
    """Arrivals in order of download, into an empty store."""
    nothing = spark.createDataFrame([], "hash_url string, hash_contenido string, ruta_relativa string, fecha_revisitacion timestamp")
    out = store.decide(_arrivals(spark, d), nothing, _now())
    return out.select("secuencia.id", "accion")


def d3_revisits(spark, d):
    """The whole table arriving once more: fresh addresses are duplicates, due ones are revisited."""
    held = _documents(spark, d).select("hash_url", "hash_contenido", "ruta_relativa", "fecha_revisitacion")
    return store.decide(_arrivals(spark, d), held, _now()).select("secuencia.id", "accion", "ruta_anterior")


def d4_freshness(spark, d):
    return store.needs_visit(table(spark, d, "frontera"), table(spark, d, "documentos"), _now())


def d5_known(spark, d):
    docs = table(spark, d, "documentos")
    front = table(spark, d, "frontera").select("hash_url").distinct()
    by_url = front.join(docs.select("hash_url").distinct().withColumn("guardada", F.lit(True)), "hash_url", "left")
    return by_url.select("hash_url", F.coalesce("guardada", F.lit(False)).alias("guardada"))


def d5_content(spark, d):
    """Whether the store holds the content of every collection text."""
    texts = text_table(spark, d, "coleccion").select("doc_id", store.content_hash(F.col("texto")).alias("hash_contenido"))
    held = table(spark, d, "documentos").where(F.col("hash_contenido").isNotNull()).select("hash_contenido").distinct().withColumn("guardado", F.lit(True))
    return texts.join(held, "hash_contenido", "left").select("doc_id", F.coalesce("guardado", F.lit(False)).alias("guardado"))


def s23_schema(spark, d):
    """The tables of a new store, made twice over."""
    root = scratch_path(spark, f"store-{uuid.uuid4().hex[:12]}")
    first = store.bootstrap(spark, root).withColumnRenamed("creada", "primera")
    return first.join(store.bootstrap(spark, root).select("tabla", F.col("creada").alias("segunda")), "tabla")


def a3_slots(spark, d):
    log = _answers(spark, d).where(F.trim("dominio") != "").withColumn("dominio", F.regexp_replace(F.lower(F.trim("dominio")), r"^www\.", ""))
    return acquisition.slots(log)


#: Robots files by the length of the host's name, and what they mean for the agent in SQL.
ROBOTS_FILES = ("User-agent: *\nDisallow: /\n", "User-agent: TeselaBot\nDisallow: /foro/\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /\n", "", "User-agent: *\nAllow: /foro/a\nDisallow: /foro/\nDisallow: /p\nCrawl-delay: 30\n")


def a1_files(spark, d):
    host = urls.native_host(F.col("url"))
    robots = F.element_at(F.array(*[F.lit(x) for x in ROBOTS_FILES]), F.pmod(F.char_length(host), F.lit(4)) + 1)
    return _targets(spark, d).select("url", html.robots_allow(robots, F.lit(200), F.col("url")).alias("permitida"), html.robots_delay(robots, F.lit(200)).alias("demora"))


def f7_states(spark, d):
    """The decision for every page under the code and the action of the log row with its number."""
    action = F.upper(F.trim("accion"))
    log = _log(spark, d).select(F.col("id").alias("pagina_id"), "codigo_http", (action != "BLOQUEADO_ROBOTS").alias("permitido"), (action != "NO_HTML").alias("es_html"))
    rows = _quality(spark, d).join(log, "pagina_id").select(
        "pagina_id", "permitido", "codigo_http", "es_html", F.coalesce("directivas_robots", F.array().cast("array<string>")).alias("directivas"), urls.is_hub(F.col("url"), F.col("titulo")).alias("es_hub"), "rechazo", F.lit(store.STORED).alias("tienda"))
    return rows.select("pagina_id", frontier.page_action().alias("accion"), frontier.follows_links().alias("sigue_enlaces"))


def a6_goal(spark, d):
    """The crawl with half of all bytes as its goal."""
    p = _pages(spark, d)
    sizes = p.select("url", F.octet_length(F.coalesce("texto", F.lit(""))).cast("long").alias("bytes"))
    goal = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b // 2
    return _crawl(spark, d, sizes=sizes, goal=goal)


PAGE_HEAD = '<html><head><base href="https://base.example/dir/x.html"><title> Uno  &amp; {n}\n</title><meta name="ROBOTS" content="NoIndex; nofollow,noindex"><style>p{{}}</style></head><body><header>fuera<p>fuera</p></header><div>Alfa {n}<span> beta</span><p>Gama<p>Delta</div>'
PAGE_TAIL = '<pre>una\n  dos</pre><ul><li>tres<li>cuatro</ul><table><tr><td>c1<td>c2</td></tr></table>fin<br/>otra <a href="rel/a#f">a</a> <a href="../b?c=1">b</a><a href="mailto:x@y.z">m</a><a href="JavaScript:x">j</a><a href="#z">z</a><a href="//otro.example/d">d</a><a href="ftp://e.example/">e</a><a href="rel/a">a</a><form>fuera</form><footer>fuera</footer><p>cola'


def h1_pages(spark, d):
    """Pages with a base, ignored and nested elements, preformatted text, open tags and links of every kind."""
    n = F.col("pagina_id").cast("string")
    page = F.replace(F.lit((PAGE_HEAD + PAGE_TAIL).replace("{{}}", "{}")), F.lit("{n}"), n)
    r = html.parse_html(page, F.col("url"))
    return _pages(spark, d).select("pagina_id", r.alias("r")).select("pagina_id", "r.titulo", "r.texto", F.array_join("r.enlaces", " ").alias("enlaces"), F.array_join("r.directivas_robots", " ").alias("directivas"))


def r4_lookup(spark, d):
    return reports.lookup(_ranked(spark, d))


def d6_paths(spark, d):
    c = F.col
    return _documents(spark, d).select("id", store.document_path(c("dominio"), c("categoria"), c("hash_contenido")).alias("ruta"), store.safe_component(F.concat(F.lit("..Años  "), c("url"), F.lit("--"))).alias("carpeta"))


def d7_audit(spark, d):
    return store.audit(_log(spark, d))


def d8_summary(spark, d):
    return store.summary(_documents(spark, d), _log(spark, d))


def _events(spark, d):
    """The audit log as frontier events: answers register an address, errors fail it, the rest settles it."""
    action = F.upper(F.trim("accion"))
    kind = F.when(action == "RESPUESTA", frontier.REGISTER).when(action == "ERROR", frontier.FAILED).otherwise(frontier.VISITED)
    return _log(spark, d).select(F.col("url_destino").alias("clave"), F.struct("instante", "id").alias("orden"), kind.alias("tipo"), F.col("url_destino").alias("url"), F.pmod(F.col("id"), F.lit(5)).cast("int").alias("profundidad"), "url_origen")


def f1_f3_fold(spark, d):
    return frontier.fold(_events(spark, d)).select("clave", "profundidad", "prioridad", "url_origen", "estado", "intentos")


def f4_queue(spark, d):
    return frontier.eligible(frontier.current(table(spark, d, "frontera"))).select("id", "hash_url", "url", "profundidad", "prioridad", "url_origen")


def f5_reconcile(spark, d):
    return frontier.reconcile(frontier.current(table(spark, d, "frontera")), table(spark, d, "documentos"), _now())


def f6_crawl(spark, d):
    return _crawl(spark, d)


def _crawl(spark, d, **bounds):
    p = _pages(spark, d)
    links = p.select("url", F.explode("enlaces").alias("enlace"))
    edges = links.unionByName(p.select(F.concat(F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1), F.lit("/")).alias("url"), F.col("url").alias("enlace")))
    return frontier.crawl(edges.select("url").where(F.col("url").endswith("/")), edges, **bounds)


def f7_actions(spark, d):
    first = _quality(spark, d).withColumn("huella", store.content_hash(F.coalesce("texto", F.lit(""))))
    owner = first.groupBy("huella").agg(F.min("pagina_id").alias("duena"))
    rows = first.join(owner, "huella").select(
        "pagina_id", F.lit(True).alias("permitido"), F.lit(200).alias("codigo_http"), F.lit(True).alias("es_html"), F.coalesce("directivas_robots", F.array().cast("array<string>")).alias("directivas"),
        urls.is_hub(F.col("url"), F.col("titulo")).alias("es_hub"), "rechazo", F.when(F.col("pagina_id") == F.col("duena"), store.STORED).otherwise(store.SAME_CONTENT).alias("tienda"),
    )
    return rows.select("pagina_id", frontier.page_action().alias("accion"), frontier.follows_links().alias("sigue_enlaces"))


ROBOTS = "User-agent: *\nDisallow: /foro/\nAllow: /\n"


def a1_robots(spark, d):
    u = F.col("url")
    code = F.when(urls.native_host(u).endswith(".test"), 403).when(urls.native_host(u).startswith("www."), 404).otherwise(200)
    return _targets(spark, d).select("url", html.robots_allow(F.lit(ROBOTS), code, u).alias("permitida"))


def _answers(spark, d):
    return _log(spark, d).where(F.upper(F.trim("accion")).isin("RESPUESTA", "ERROR"))


def a2_delay(spark, d):
    return acquisition.adaptive_delay(_answers(spark, d).where(F.trim("dominio") != "")).select("dominio", F.round("demora", 6).alias("demora"), "respuestas")


def a4_retries(spark, d):
    return acquisition.retries(_answers(spark, d))


def a5_size(spark, d):
    return _pages(spark, d).select("pagina_id", acquisition.within_size(F.col("texto")).alias("cabe"))


def r1_domains(spark, d):
    return reports.by_domain(_documents(spark, d).select("dominio", F.col("tamano_texto_bytes").alias("bytes")))


def _ranked(spark, d):
    return materialize(reports.word_frequency(text_table(spark, d, "coleccion").select("texto")), "words")


def r2_words(spark, d):
    return _ranked(spark, d).select("rango", "palabra", "frecuencia", F.round("relativa", 9).alias("relativa"))


def r3_zipf(spark, d):
    return reports.zipf(_ranked(spark, d)).select("c", F.round("pendiente", 6).alias("pendiente"), F.round("r2", 6).alias("r2"))


def r4_hapax(spark, d):
    return reports.hapax(_ranked(spark, d)).select("palabras", "hapax", F.round("proporcion", 9).alias("proporcion"))


def r5_actions(spark, d):
    return reports.actions(_log(spark, d))


def queries() -> dict[str, Query]:
    return {
        "s1_scan": s1_scan, "s2_count": s2_count, "s15_hash_bytes": s15_hash_bytes, "u1_u7_canonical": u1_canonical, "u5_tracking": u5_tracking, "u8_u11_hosts": u8_hosts, "u8_u10_python_hosts": u9_python_hosts,
        "u12_allowed": u12_allowed, "u13_admission": u13_admission, "u14_hubs": u14_hubs, "h1_h3_parse": h1_parse, "h2_tidy": h2_tidy, "h4_directives": h4_directives, "h5_h7_quality": h5_h7_quality,
        "h7_collection": h7_collection, "h8_responses": h8_responses, "d1_content_hash": d1_content, "d2_raw_hash": d2_raw_hash, "d3_decisions": d3_decisions, "d3_revisits": d3_revisits, "d4_freshness": d4_freshness,
        "d5_known": d5_known, "d6_paths": d6_paths, "d7_audit": d7_audit, "d8_summary": d8_summary, "f1_f3_fold": f1_f3_fold, "f4_queue": f4_queue, "f5_reconcile": f5_reconcile, "f6_a6_crawl": f6_crawl,
        "f7_actions": f7_actions, "a1_robots": a1_robots, "a2_delay": a2_delay, "a4_retries": a4_retries, "a5_size": a5_size, "r1_domains": r1_domains, "r2_words": r2_words, "r3_zipf": r3_zipf, "r4_hapax": r4_hapax,
        "r5_actions": r5_actions, "d5_content": d5_content, "s23_schema": s23_schema, "a3_slots": a3_slots, "a1_files": a1_files, "f7_states": f7_states, "a6_goal": a6_goal, "h1_h3_pages": h1_pages, "r4_lookup": r4_lookup,
    }


_DOCS = "(SELECT DISTINCT * FROM documentos)"
_LOG = "(SELECT DISTINCT ON (id) * FROM bitacora_recorrido)"
_TARGETS = "(SELECT DISTINCT u AS url FROM (SELECT unnest([url_destino, url_origen]) AS u FROM bitacora_recorrido) WHERE u IS NOT NULL)"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1))"
_CURRENT = "(SELECT DISTINCT ON (id) * FROM frontera ORDER BY id, actualizada_en DESC)"
_BLANK = r"[\t\x0B\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NORMAL = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(texto), '\\r\\n?', chr(10), 'g'), '{_BLANK}+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
_TIDY = r"trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(texto, '[ \t\f\x0B\r\x{a0}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)), '(?i)^(?:apariencia\s*\n+)+', ''), ' ' || chr(10))"


def _suffix_sql(host: str) -> str:
    labels = f"string_split({host}, '.')"
    size = f"len({labels})"
    tail = lambda k: f"array_to_string({labels}[-{k}:], '.')"
    known = lambda k: "(" + ", ".join(f"'{s}'" for s in sorted(urls.SUFFIXES) if s.count(".") == k - 1) + ")"
    return f"CASE WHEN regexp_matches({host}, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') OR {size} <= 1 THEN {host} WHEN {size} > 2 AND {tail(2)} IN {known(2)} THEN {tail(3)} ELSE {tail(2)} END"


def _quality_sql(text: str, title: str, url: str) -> tuple[str, str, str]:
    lines = f"list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '')"
    start = f"array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '\\r\\n|\\n|\\r')[1:10], lambda x: lower(trim(x))), lambda x: x <> ''), ' ')"
    dis = " OR ".join([f"contains(lower(coalesce({c}, '')), '{w}')" for c in (url, title) for w in html._DISAMBIGUATION_NAMES] + [f"contains({start}, '{p}')" for p in html._DISAMBIGUATION_PHRASES])
    hints = "[" + ", ".join(f"'{x}'" for x in html._LIST_HINTS.split()) + "]"
    words = lambda t: f"regexp_extract_all(lower({t}), '[a-záéíóúüñ]+')"
    name = f"translate(string_split(regexp_extract(coalesce({url}, ''), '^[^?#]*?://[^/?#]*([^?#]*)', 1), '/')[-1], '_', ' ')"
    hinted = f"(list_has_any({words(name)}, {hints}) OR list_has_any({words(f"coalesce({title}, '')")}, {hints}))"
    content = f"list_filter({lines}, lambda x: length(x) <= 300 AND length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 3)"
    entry = r"(?i)^(?:(?:\p{Nd}+|[a-zivx]+)[.)]|[•▪◦*\-])\s+|^.{2,160}?\s+[—–|]\s+.{2,}$"
    entries = f"list_filter({content}, lambda x: regexp_matches(x, '{entry}'))"
    is_list = f"(len({lines}) >= 3 AND (({hinted} AND len({entries}) >= 2) OR ({hinted} AND len({content}) >= 0.60 * len({lines})) OR (len({entries}) >= 3 AND len({entries}) >= 0.45 * len({lines}))))"
    t = f"coalesce({text}, '')"
    limit = lambda i: f"CASE WHEN {is_list} THEN {html.LIMITS[True][i]} ELSE {html.LIMITS[False][i]} END"
    count = f"len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}]{{2,}}'))"
    solid = f"regexp_replace({t}, '[\\s\\x{{0B}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1c}}-\\x{{1f}}]', '', 'g')"
    density = f"CASE WHEN length({solid}) > 0 THEN length(regexp_replace({solid}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE / length({solid}) ELSE 0 END"
    reject = (
        f"CASE WHEN {dis} THEN 'desambiguacion' WHEN length({t}) < {limit(0)} THEN 'longitud ' || length({t}) || ' < ' || ({limit(0)})"
        f" WHEN {count} < {limit(1)} THEN 'palabras ' || {count} || ' < ' || ({limit(1)}) WHEN {density} < {limit(2)} THEN 'densidad' END"
    )
    return dis, is_list, reject


def oracle_sql() -> dict[str, str]:
    dis, listed, reject = _quality_sql("texto", "titulo", "url")
    _, _, reject_docs = _quality_sql("texto", "NULL::VARCHAR", "url")
    tracking = "(" + ", ".join(f"'{t}'" for t in urls.TRACKING) + ")"
    prefixes = "^(?:" + "|".join(urls.TRACKING_PREFIXES) + ")"
    parts = "list_filter(string_split(concat_ws('&', 'utm_source=feed', q, 'FBCLID=1', 'ref=x'), '&'), lambda p: NOT (lower(trim(string_split(p, '=')[1])) IN " + tracking + f" OR regexp_matches(lower(trim(string_split(p, '=')[1])), '{prefixes}')))"
    odd = f"(SELECT url FROM {_TARGETS} UNION SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || x FROM {_TARGETS}, (VALUES ('/a.PDF'), ('/wiki/Talk:X'), ('/w?action=edit'), ('/pmwiki/pmwiki.php/YMMV/X'), ('/wiki/Category:Cine'), ('/wiki/Cine_(desambiguaci%C3%B3n)'), ('/ok.html')) v(x))"
    http = r"regexp_matches(url, '(?i)^https?://(?:[^/@?#\s]*@)?[^/:?#\s]+[^\s]*$')"
    name = "lower(string_split(url_decode(regexp_extract(url, '^[^?#]*?://[^/?#]*([^?#]*)', 1)), '/')[-1])"
    ext = "(" + ", ".join(f"'{x}'" for x in urls.EXCLUDED_EXTENSIONS) + ")"
    refused = " OR ".join(f"regexp_matches(url_decode(url), '(?i){p}')" for p in (urls._ACTIONS, urls._NAMESPACES, urls._META_PAGES))
    events = f"(SELECT url_destino AS clave, row_number() OVER (ORDER BY instante, id) AS o, upper(trim(accion)) AS a, (id % 5)::INTEGER AS profundidad, url_origen FROM {_LOG})"
    answers = f"(SELECT * FROM {_LOG} WHERE upper(trim(accion)) IN ('RESPUESTA', 'ERROR'))"
    codes = "(" + ", ".join(map(str, acquisition.RETRY_CODES)) + ")"
    seq = f"(SELECT *, row_number() OVER (ORDER BY fecha_descarga, id) AS o FROM {_DOCS})"
    words = f"(SELECT palabra, count(*) AS frecuencia FROM (SELECT unnest({_word_tokens()}) AS palabra FROM coleccion) GROUP BY palabra)"
    ranked = f"(SELECT row_number() OVER (ORDER BY frecuencia DESC, encode(palabra)) AS rango, palabra, frecuencia FROM {words})"
    now = f"TIMESTAMPTZ '{NOW}+00'"
    open_ = "(estado = 'pendiente' OR (estado = 'error' AND intentos < 3))"
    safe = lambda t: f"(SELECT CASE WHEN z = '' THEN 'documento' ELSE z END FROM (SELECT rtrim(substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents({t}), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9._-]', '-', 'g'), '-+', '-', 'g'), '\\.{{2,}}', '.', 'g'), '._-'), 1, 120), '._-') AS z))"
    dirty = "regexp_replace(trim(regexp_replace(x, '[ \\t\\f\\x0B\\r\\x{a0}]+', ' ', 'g')), '^\\s+|\\s+$', '', 'g')"
    kept_lines = f"list_filter(list_transform(string_split(coalesce(texto, ''), chr(10)), lambda x: {dirty}), lambda x: x <> '')"
    body = f"CASE WHEN lower({kept_lines}[1]) = 'apariencia' THEN {kept_lines}[2:] ELSE {kept_lines} END"
    encode = "url_encode(nfc_normalize({t}))"
    for sign in "/:@!$&'()*+,;=":
        encode = f"replace({encode}, '%{ord(sign):02X}', chr({ord(sign)}))"
    pairs = "list_transform(string_split(q, '&'), lambda p: string_split(p, '='))"
    query = f"array_to_string(list_transform(list_sort(list_transform({pairs}, lambda p: [p[1], p[2]])), lambda p: url_encode(p[1]) || '=' || url_encode(p[2])), '&')"
    address = f"s || '://' || h || {encode.format(t='p')} || CASE WHEN q <> '' THEN '?' || {query} ELSE '' END"
    admitted = "length({u}) <= " + str(urls.MAX_URL) + " AND NOT contains({u}, '.pdf') AND {u} IS NOT NULL"
    crawled = f"""WITH RECURSIVE p AS (SELECT url, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/' AS raiz, enlaces FROM resultado_html),
e AS (SELECT url AS origen, unnest(enlaces) AS url FROM p UNION SELECT raiz, url FROM p),
c AS (SELECT DISTINCT origen AS url, 0 AS d FROM e WHERE ends_with(origen, '/') UNION SELECT e.url, d + 1 FROM c JOIN e ON e.origen = c.url WHERE d < {frontier.MAX_DEPTH} AND {admitted.format(u='e.url')}),
m AS (SELECT url, min(d) AS profundidad FROM c GROUP BY url),
q AS (SELECT m.url, m.profundidad, min(e.origen) AS url_origen FROM m LEFT JOIN (SELECT e.url, e.origen, o.profundidad FROM e JOIN m o ON o.url = e.origen) e ON e.url = m.url AND e.profundidad = m.profundidad - 1 GROUP BY m.url, m.profundidad)"""
    file_of = f"length({_HOST}) % 4"
    path_of = "regexp_extract(url, '^[a-z]+://[^/]+(.*)', 1)"
    hub = f"regexp_matches(url_decode(url), '(?i){urls._HUB}|{urls._HUB_TITLE}') OR regexp_matches(coalesce(titulo, ''), '(?i){urls._HUB}|{urls._HUB_TITLE}')"
    host_answers = f"(SELECT id, regexp_replace(lower(trim(dominio)), '^www\\.', '') AS dominio, instante, epoch_us(instante) AS llegada, round(least({acquisition.TIMEOUT}e3, greatest(0.0, coalesce(tiempo_respuesta_ms, 0.0))) * 1e3)::BIGINT AS dura FROM {answers} WHERE trim(dominio) <> '')"
    return {
        "d5_content": f"SELECT doc_id, sha256({_NORMAL}) IN (SELECT hash_contenido FROM documentos WHERE hash_contenido IS NOT NULL) AS guardado FROM coleccion",
        "s23_schema": "SELECT * FROM (VALUES ('documentos', 12, true, false), ('bitacora_recorrido', 8, true, false), ('frontera', 9, true, false), ('migraciones', 3, true, false)) v(tabla, columnas, primera, segunda)",
        "a3_slots": f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY dominio ORDER BY instante, id) - 1 AS k FROM {host_answers}),
b AS (SELECT *, max(llegada - 750000 * k) OVER (PARTITION BY dominio ORDER BY k) + 750000 * k AS turno FROM a),
c AS (SELECT *, list(turno + dura) OVER (PARTITION BY dominio ORDER BY k ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS fines FROM b)
SELECT id, dominio, llegada, turno::BIGINT AS turno, coalesce(len(list_filter(fines, lambda x: x > turno)), 0)::INTEGER AS activas, coalesce(len(list_filter(fines, lambda x: x > turno)), 0) < {acquisition.MAX_ACTIVE} AS libre FROM c""",
        "a1_files": f"SELECT url, CASE {file_of} WHEN 0 THEN false WHEN 1 THEN NOT starts_with({path_of}, '/foro/') WHEN 2 THEN true ELSE starts_with({path_of}, '/foro/a') OR NOT (starts_with({path_of}, '/foro/') OR starts_with({path_of}, '/p')) END AS permitida, CASE {file_of} WHEN 1 THEN 2.0 WHEN 3 THEN 10.0 ELSE 0.75 END::DOUBLE AS demora FROM {_TARGETS}",
        "f7_states": f"WITH q AS (SELECT *, {reject} AS rechazo, coalesce(directivas_robots, []) AS dr FROM resultado_html), l AS (SELECT id, codigo_http, upper(trim(accion)) AS a FROM {_LOG}) SELECT pagina_id, CASE WHEN a = 'BLOQUEADO_ROBOTS' THEN 'BLOQUEADO_ROBOTS' WHEN codigo_http IS NULL OR codigo_http >= 400 THEN 'ERROR' WHEN codigo_http NOT BETWEEN 200 AND 299 THEN NULL WHEN a = 'NO_HTML' THEN 'NO_HTML' WHEN list_has_any(dr, ['noindex', 'none']) THEN 'NOINDEX' WHEN {hub} THEN NULL WHEN rechazo IS NOT NULL THEN 'BAJA_DENSIDAD' ELSE 'ALMACENADO' END AS accion, NOT list_has_any(dr, ['nofollow', 'none']) AS sigue_enlaces FROM q JOIN l ON id = pagina_id",
        "a6_goal": crawled + ", t AS (SELECT url, strlen(coalesce(texto, ''))::BIGINT AS b FROM resultado_html), g AS (SELECT profundidad, sum(sum(coalesce(b, 0))) OVER (ORDER BY profundidad) AS hasta FROM q LEFT JOIN t USING (url) GROUP BY profundidad) SELECT url, profundidad, url_origen FROM q WHERE profundidad <= coalesce((SELECT min(profundidad) FROM g WHERE hasta >= (SELECT sum(b) // 2 FROM t)), 99)",
        "h1_h3_pages": "SELECT pagina_id, 'Uno & ' || pagina_id AS titulo, array_to_string(['Alfa ' || pagina_id || ' beta', 'Gama', 'Delta', '', 'una', 'dos', '', 'tres', 'cuatro', '', 'c1c2', '', 'fin', 'otra a bmjzdea', 'cola'], chr(10)) AS texto, 'https://base.example/dir/rel/a https://base.example/b?c=1 https://otro.example/d' AS enlaces, 'nofollow noindex' AS directivas FROM resultado_html",
        "r4_lookup": f"WITH r AS {ranked} SELECT p AS palabra, rango, coalesce(frecuencia, 0) AS frecuencia FROM (SELECT unnest([" + ", ".join(f"'{w}'" for w in reports.TRADE_WORDS) + "]) AS p) LEFT JOIN r ON palabra = p",
        "h1_h3_parse": f"SELECT pagina_id, trim(regexp_replace(coalesce(titulo, ''), '\\s+', ' ', 'g')) AS titulo, len(list_distinct(coalesce(enlaces, [])))::INTEGER AS enlaces, md5(array_to_string({body}, chr(10) || chr(10))) AS texto, list_sort(list_distinct(list_transform(coalesce(directivas_robots, []), lambda x: lower(trim(x))))) AS directivas_robots FROM resultado_html",
        "u1_u7_canonical": f"SELECT url, c AS canonica, sha256(c) AS huella FROM (SELECT url, {address} AS c FROM (SELECT url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, {_HOST} AS h, CASE WHEN regexp_extract(url, '^[^?#]*?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^?#]*?://[^/?#]*([^?#]*)', 1) END AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM {_TARGETS}))",
        "f6_a6_crawl": crawled + " SELECT url, profundidad, url_origen FROM q",
        "s1_scan": "SELECT row_number() OVER (ORDER BY id) - 1 AS doc_id, id, hash_url, strlen(texto)::INTEGER AS bytes FROM (SELECT DISTINCT d.id, d.hash_url, c.texto FROM documentos d JOIN coleccion c ON c.db_id = d.id)",
        "s2_count": "SELECT count(DISTINCT id) AS total, least(count(DISTINCT id), 100) AS con_limite FROM documentos",
        "s15_hash_bytes": f"SELECT id, upper(trim(hash_url)) AS bytes FROM {_DOCS}",
        "u5_tracking": f"SELECT url, array_to_string({parts}, '&') AS consulta FROM (SELECT url, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM {_TARGETS}) WHERE q <> ''",
        "u8_u11_hosts": f"SELECT url, host, {_suffix_sql('host')} AS registrable, regexp_replace(host, '^www\\.', '') AS origen, es_http FROM (SELECT url, {_HOST} AS host, {http} AS es_http FROM {_TARGETS})",
        "u8_u10_python_hosts": f"SELECT url, host, {_suffix_sql('host')} AS registrable, regexp_replace(host, '^www\\.', '') AS origen FROM (SELECT url, {_HOST} AS host FROM {_TARGETS})",
        "u12_allowed": f"WITH h AS (SELECT DISTINCT regexp_replace(lower(trim(dominio)), '^www\\.', '') AS p FROM coleccion), t AS (SELECT url, regexp_replace({_HOST}, '^www\\.', '') AS x FROM {_TARGETS}) SELECT url, EXISTS (SELECT 1 FROM h WHERE x = p OR ends_with(x, '.' || p)) AS permitido FROM t",
        "u13_admission": f"SELECT url, (length(url) <= {urls.MAX_URL} AND {http} AND NOT regexp_matches(url, '://[^/?#]*@') AND NOT (contains({name}, '.') AND string_split({name}, '.')[-1] IN {ext}) AND NOT ({refused})) AS admitida FROM {odd}",
        "u14_hubs": f"SELECT url, regexp_matches(url_decode(url), '(?i){urls._HUB}') OR regexp_matches(url_decode(url), '(?i){urls._HUB_TITLE}') AS es_hub FROM {odd}",
        "h2_tidy": f"SELECT pagina_id, md5({_TIDY}) AS texto FROM resultado_html",
        "h4_directives": "SELECT pagina_id, array_to_string(list_sort(list_distinct(list_transform(coalesce(directivas_robots, []), lambda x: lower(trim(x))))), ',') AS directivas FROM resultado_html",
        "h5_h7_quality": f"SELECT pagina_id, {dis} AS desambiguacion, {listed} AS es_lista, {reject} AS rechazo FROM resultado_html",
        "h7_collection": f"SELECT doc_id, {reject_docs} AS rechazo FROM coleccion",
        "h8_responses": "SELECT pagina_id, true AS es_html, md5(regexp_replace(coalesce(texto, ''), '[^\\x{00}-\\x{FF}]', '?', 'g')) AS texto FROM resultado_html",
        "d1_content_hash": f"SELECT doc_id, sha256({_NORMAL}) AS normal, sha256(texto) AS cruda FROM coleccion",
        "d2_raw_hash": f"SELECT url, sha256(url) AS huella FROM {_TARGETS}",
        "d3_decisions": f"WITH s AS (SELECT id, hash_url, hash_contenido, o, min(o) OVER (PARTITION BY hash_url) AS pu, min(o) OVER (PARTITION BY hash_contenido) AS pc FROM {seq}) SELECT id, CASE WHEN o = pu AND o = pc THEN 'ALMACENADO' WHEN o > pu AND EXISTS (SELECT 1 FROM s t WHERE t.hash_url = s.hash_url AND t.o = t.pu AND t.o = t.pc) THEN 'DUPLICADO_URL' ELSE 'DUPLICADO_CONTENIDO' END AS accion FROM s",
        "d3_revisits": f"SELECT id, CASE WHEN fecha_revisitacion IS NOT NULL AND fecha_revisitacion > {now} THEN 'DUPLICADO_URL' WHEN count(*) OVER (PARTITION BY hash_contenido) > 1 THEN 'DUPLICADO_CONTENIDO' ELSE 'REVISITADO' END AS accion, NULL::VARCHAR AS ruta_anterior FROM {_DOCS}",
        "d4_freshness": f"SELECT f.hash_url, (max(d.fecha_revisitacion) IS NULL OR max(d.fecha_revisitacion) <= {now}) AS vencida FROM frontera f LEFT JOIN documentos d USING (hash_url) GROUP BY f.hash_url",
        "d5_known": "SELECT DISTINCT hash_url, hash_url IN (SELECT hash_url FROM documentos) AS guardada FROM frontera",
        "d6_paths": f"SELECT id, {safe('dominio')} || '/' || {safe('categoria')} || '/' || hash_contenido[1:2] || '/' || hash_contenido || '.txt' AS ruta, {safe("'..Años  ' || url || '--'")} AS carpeta FROM {_DOCS}",
        "d7_audit": f"SELECT id, instante, CASE WHEN coalesce(dominio, '') = '' THEN '(desconocido)' ELSE dominio END AS dominio, url_origen, url_destino, greatest(0.0, coalesce(tiempo_respuesta_ms, 0.0)) AS tiempo_respuesta_ms, codigo_http, upper(trim(accion)) AS accion FROM {_LOG}",
        "d8_summary": f"SELECT (SELECT count(*) FROM {_DOCS}) AS documentos, (SELECT coalesce(sum(tamano_texto_bytes), 0)::BIGINT FROM {_DOCS}) AS bytes, (SELECT count(*) FROM {_LOG}) AS bitacora",
        "f1_f3_fold": f"""WITH e AS (SELECT * FROM {events} WHERE clave IS NOT NULL),
r AS (SELECT clave, max(o) AS u, arg_max(profundidad, o) AS profundidad, arg_max(url_origen, o) FILTER (url_origen IS NOT NULL) AS url_origen FROM e WHERE a = 'RESPUESTA' GROUP BY clave),
l AS (SELECT e.clave, sum((a = 'ERROR')::INTEGER) AS n, arg_max(a, o) AS fin FROM e JOIN r USING (clave) WHERE a <> 'RESPUESTA' AND o > u GROUP BY e.clave)
SELECT clave, profundidad, -profundidad::DOUBLE AS prioridad, url_origen, CASE WHEN fin IS NULL THEN 'pendiente' WHEN fin = 'ERROR' AND n < 3 THEN 'error' ELSE 'visitada' END AS estado, coalesce(n, 0)::INTEGER AS intentos FROM r LEFT JOIN l USING (clave)""",
        "f4_queue": f"SELECT id, hash_url, url, profundidad, prioridad, url_origen FROM {_CURRENT} WHERE {open_}",
        "f5_reconcile": f"SELECT f.id, f.hash_url, CASE WHEN {open_} AND coalesce(v > {now}, false) THEN 'visitada' ELSE estado END AS estado, intentos, prioridad, {open_} AND coalesce(v > {now}, false) AS descartada FROM {_CURRENT} f LEFT JOIN (SELECT hash_url, max(fecha_revisitacion) AS v FROM documentos GROUP BY hash_url) d USING (hash_url)",
        "f7_actions": f"WITH q AS (SELECT *, {reject} AS rechazo, min(pagina_id) OVER (PARTITION BY {_NORMAL.replace('texto', "coalesce(texto, '')")}) AS duena, coalesce(directivas_robots, []) AS dr FROM resultado_html) SELECT pagina_id, CASE WHEN list_has_any(dr, ['noindex', 'none']) THEN 'NOINDEX' WHEN regexp_matches(url_decode(url), '(?i){urls._HUB}|{urls._HUB_TITLE}') OR regexp_matches(coalesce(titulo, ''), '(?i){urls._HUB}|{urls._HUB_TITLE}') THEN NULL WHEN rechazo IS NOT NULL THEN 'BAJA_DENSIDAD' WHEN pagina_id = duena THEN 'ALMACENADO' ELSE 'DUPLICADO_CONTENIDO' END AS accion, NOT list_has_any(dr, ['nofollow', 'none']) AS sigue_enlaces FROM q",
        "a1_robots": f"SELECT url, CASE WHEN ends_with({_HOST}, '.test') THEN false WHEN starts_with({_HOST}, 'www.') THEN true ELSE NOT starts_with(regexp_extract(url, '^[a-z]+://[^/]+(.*)', 1), '/foro/') END AS permitida FROM {_TARGETS}",
        "a2_delay": f"SELECT dominio, round(list_reduce([0.75::DOUBLE] || list(CASE WHEN coalesce(codigo_http IN {codes}, false) THEN -1.0 ELSE tiempo_respuesta_ms / 2000.0 END ORDER BY instante, id), lambda d, e: least(5.0, greatest(0.75, (d + CASE WHEN e < 0 THEN 2 * d ELSE e END) / 2))), 6) AS demora, count(*) AS respuestas FROM {answers} WHERE trim(dominio) <> '' AND tiempo_respuesta_ms IS NOT NULL GROUP BY dominio",
        "a4_retries": f"""WITH a AS (SELECT *, (codigo_http IS NULL OR codigo_http IN {codes}) AS otra, instante::DATE AS dia FROM {answers}),
b AS (SELECT *, coalesce(sum((NOT otra)::INTEGER) OVER (PARTITION BY url_destino, dia ORDER BY instante, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS racha FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY url_destino, dia, racha ORDER BY instante, id)::INTEGER AS intento FROM b),
r AS (SELECT id, url_destino, intento, CASE WHEN NOT otra AND codigo_http >= 400 THEN 'definitivo' WHEN NOT otra THEN 'ok' WHEN intento <= 3 THEN 'reintento' ELSE 'agotado' END AS resultado FROM c)
SELECT *, CASE WHEN resultado = 'reintento' THEN pow(2, intento)::INTEGER END AS espera_s FROM r""",
        "a5_size": "SELECT pagina_id, coalesce(strlen(texto) <= 5242880, true) AS cabe FROM resultado_html",
        "r1_domains": f"SELECT CASE WHEN grouping(dominio) = 1 THEN 'TOTAL' ELSE coalesce(dominio, '(desconocido)') END AS dominio, count(*) AS documentos, sum(tamano_texto_bytes)::BIGINT AS bytes, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM {_DOCS}), 4) AS porcentaje FROM {_DOCS} GROUP BY ROLLUP (dominio)",
        "r2_words": f"SELECT rango, palabra, frecuencia, round(frecuencia::DOUBLE / sum(frecuencia) OVER (), 9) AS relativa FROM {ranked}",
        "r3_zipf": f"SELECT max(frecuencia) AS c, round(regr_slope(ln(frecuencia), ln(rango)), 6) AS pendiente, round(regr_r2(ln(frecuencia), ln(rango)), 6) AS r2 FROM {ranked}",
        "r4_hapax": f"SELECT count(*) AS palabras, sum((frecuencia = 1)::INTEGER)::BIGINT AS hapax, round(sum((frecuencia = 1)::INTEGER)::DOUBLE / count(*), 9) AS proporcion FROM {words}",
        "r5_actions": f"SELECT upper(trim(accion)) AS accion, count(*) AS n FROM {_LOG} GROUP BY 1",
    }


def _word_tokens() -> str:
    from .retrieval import _BASE

    return _BASE
