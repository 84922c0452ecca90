import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tesela.functions import html, urls
from tesela.operators import acquisition, frontier, reports, store
from tesela.sources import seeds
from tesela.streaming.store import StoreStream, action_counts


def value(spark, column, text=None):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://Example.COM:80/a/../b//c/?utm_source=x&b=2&a=%7E1#f", "http://example.com/b/c/?a=~1&b=2"), ("https://ñandú.es/é?q=a+b", "https://xn--and-6ma2c.es/%C3%A9?q=a%20b"), ("https://a.com", "https://a.com/"),
        ("https://[::1]:8080/x", "https://[::1]:8080/x"), ("http://a.com/%7euser/%2f?k=&k=1", "http://a.com/~user/%2F?k=&k=1"), ("../a/./b/", "../a/b/"), ("https://u:p@a.com/", "https://u:p@a.com/"),
    ],
)
def test_canonical(raw, want):
    assert urls.canonical_url(raw) == want
    assert urls.canonical_url(want) == want


@pytest.mark.parametrize("bad", ["", "ftp://x/", "http://", "http://-a.com/", "http://a..com/", "http://a.com:99999/", "http://a\x01.com/"])
def test_canonical_refuses(bad):
    with pytest.raises(ValueError):
        urls.canonical_url(bad)


def test_url_columns(spark):
    df = spark.createDataFrame([("https://www.imsdb.com/x",), ("http://malimsdb.com/",), (None,), ("nada",)], "url string")
    got = df.select(urls.origin_host(F.col("url")).alias("o"), urls.allowed_host(urls.native_host(F.col("url")), F.array(F.lit("imsdb.com"))).alias("p"), urls.is_http(F.col("url")).alias("h"), urls.canonical(F.col("url")).alias("c")).collect()
    assert [r.o for r in got] == ["imsdb.com", "malimsdb.com", None, "nada"]
    assert [r.p for r in got[:2]] == [True, False] and [r.h for r in got] == [True, True, False, False] and got[2].c is None
    assert urls.registrable("a.b.example.co.uk") == "example.co.uk" and urls.registrable("x.y.zz") == "y.zz" and urls.registrable("10.0.0.1") == "10.0.0.1" and urls.registrable("uno") == "uno"
    assert len(urls.SUFFIXES) == 231


def test_admission(spark):
    good = ["https://es.wikipedia.org/wiki/Cine", "https://imsdb.com/scripts/X.html", "http://a.com/a?diffuse=1"]
    bad = [
        "https://a.com/x.pdf", "https://a.com/w?action=edit", "https://a.com/w?x=1&oldid=3", "https://es.wikipedia.org/wiki/Especial:X", "https://es.wikipedia.org/wiki/Discusi%C3%B3n:X", "https://tvtropes.org/pmwiki/pmwiki.php/YMMV/X",
        "https://u:p@a.com/", "ftp://a.com/", "https://a.com/" + "x" * 2100,
    ]
    df = spark.createDataFrame([(u,) for u in good + bad], "url string")
    assert [r[0] for r in df.select(urls.admissible(F.col("url"))).collect()] == [True] * len(good) + [False] * len(bad)
    assert value(spark, urls.is_hub(F.col("t"), F.lit(None).cast("string")), "https://x.org/wiki/Categor%C3%ADa:Cine") and not value(spark, urls.is_hub(F.col("t"), F.lit("Cine")), "https://x.org/wiki/Cine")
    assert value(spark, urls.is_hub(F.col("t"), F.lit("Roma (desambiguación)")), "https://x.org/wiki/Roma")


PAGE = """<html><head><title> El  cine </title><meta name="Robots" content="NoFollow; noindex"><base href="/b/"></head>
<body><nav><a href="/menu">menú</a>menú</nav><h1>Título</h1><p>Uno<br>dos   tres</p><table><tr><td>a</td><td>b</td></tr></table>
<pre>x
y</pre><script>var a="</p>";</script><a href="c#d">c</a><a href="c">otra</a><a href="mailto:x">m</a><p>roto <b>fin"""


def test_html():
    got = html.read_html(PAGE, "https://a.com/z/")
    assert got["titulo"] == "El cine" and got["directivas_robots"] == ["nofollow", "noindex"]
    assert got["enlaces"] == ["https://a.com/menu", "https://a.com/b/c"]
    assert "menú" not in got["texto"] and "var a" not in got["texto"] and "x\ny" in got["texto"] and "dos tres" in got["texto"] and got["texto"].endswith("fin") and "a b" in got["texto"]
    assert html.read_html(None, None)["texto"] == "" and html.tidy("Apariencia\n\nApariencia \n Hola\n\n\n\nya ") == "Hola\n\nya"


def test_quality(spark):
    words = "palabra larga de relleno para llegar al tamaño pedido en esta prueba concreta. "
    n = F.lit(None).cast("string")
    why = lambda t, title=n, u=n: value(spark, html.rejection(F.col("t"), html.is_list(F.col("t"), title, u), title, u), t)
    assert why(words * 12) is None and why(words) == f"longitud {len(words)} < 500" and why(None) == "longitud 0 < 500"
    assert why("Cine puede referirse a:\n" + words * 12) == "desambiguacion" and why(words * 12, F.lit("Roma (desambiguación)")) == "desambiguacion"
    assert why("x" * 600) == "palabras 1 < 100" and why("ab " * 101 + "-" * 4000) == "densidad"
    rows = "\n".join(f"{i}. Entrada número {i} de la lista de cine con palabras de sobra para la prueba" for i in range(1, 9))
    assert value(spark, html.is_list(F.col("t"), n, n), rows) and not value(spark, html.is_list(F.col("t"), n, n), "1. a\n2. b")
    assert why(rows) is None


def test_responses_and_robots(spark):
    df = spark.createDataFrame([("año".encode("latin-1"), "text/html; charset=ISO-8859-1"), ("<meta charset=utf-8>ñ".encode(), None), (b"x", "text/html; charset=nada"), (None, "image/png")], "b binary, h string")
    got = df.select(html.decode_body("b", "h").alias("t"), html.is_html(F.col("h")).alias("k")).collect()
    assert [r.t for r in got] == ["año", "<meta charset=utf-8>ñ", "x", None] and [r.k for r in got] == [True, True, True, False]
    rows = [("User-agent: *\nDisallow: /no", 200, "http://a.com/no/x", False), ("User-agent: *\nDisallow: /no", 200, "http://a.com/si", True), ("", 403, "http://a.com/", False), (None, 404, "http://a.com/", True), (None, None, "http://a.com/", True)]
    df = spark.createDataFrame(rows, "r string, c int, u string, w boolean")
    assert all(r.g == r.w for r in df.withColumn("g", html.robots_allow("r", "c", "u")).collect())


def test_content_identity(spark):
    same = ["Hola  mundo\r\n fin ", "Hola\u00a0mundo\n\tfin", "Hola mundo \n\nfin".replace("\n\n", "\n")]
    df = spark.createDataFrame([(x,) for x in same] + [(None,)], "t string")
    got = [r[0] for r in df.select(store.content_hash(F.col("t"))).collect()]
    assert len(set(got[:3])) == 1 and got[3] is None
    assert value(spark, store.document_path(F.lit("Cañón.com"), F.lit("a/b  c"), F.col("t")), "AB" * 32) == f"Canon.com/a-b-c/ab/{'ab' * 32}.txt"
    assert value(spark, store.document_path(F.lit("x"), F.lit("y"), F.col("t")), "corto") is None and value(spark, store.safe_component(F.col("t")), "...") == "documento"


def sequential(log, held, now):
    """The rule row by row: (action, old path)."""
    rows = {u: (c, p, due) for u, c, p, due in held}
    out = []
    for url, content, path in log:
        if url in rows:
            c, p, due = rows[url]
            if due is not None and due > now:
                out.append(("DUPLICADO_URL", None))
            elif any(v[0] == content for k, v in rows.items() if k != url):
                out.append(("DUPLICADO_CONTENIDO", None))
            else:
                rows[url] = (content, path, now + 30)
                out.append(("REVISITADO", p if p != path else None))
        elif any(v[0] == content for v in rows.values()):
            out.append(("DUPLICADO_CONTENIDO", None))
        else:
            rows[url] = (content, path, now + 30)
            out.append(("ALMACENADO", None))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_decisions(spark, seed):
    """New addresses against the sequential rule, with many collisions."""
    r = random.Random(seed)
    log = [(f"u{r.randrange(8)}", f"c{r.randrange(6)}", f"p{r.randrange(99)}") for _ in range(24)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(log)], "secuencia long, hash_url string, hash_contenido string, ruta_relativa string")
    none = spark.createDataFrame([], "hash_url string, hash_contenido string, ruta_relativa string, fecha_revisitacion timestamp")
    got = [(x.accion, x.ruta_anterior) for x in store.decide(df, none, F.lit(dt.datetime(2024, 1, 1))).orderBy("secuencia").collect()]
    assert got == sequential(log, [], 0)


def test_revisits(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    held = spark.createDataFrame([("u1", "c1", "p1", day(1)), ("u2", "c2", "p2", day(20)), ("u3", "c3", "p3", None)], "hash_url string, hash_contenido string, ruta_relativa string, fecha_revisitacion timestamp")
    log = [("u1", "c9", "p9"), ("u2", "c8", "p8"), ("u3", "c2", "px"), ("u4", "c3", "p4"), ("u3", "c3", "p3")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(log)], "secuencia long, hash_url string, hash_contenido string, ruta_relativa string")
    got = [(x.accion, x.ruta_anterior) for x in store.decide(df, held, F.lit(day(10))).orderBy("secuencia").collect()]
    assert got == [("REVISITADO", "p1"), ("DUPLICADO_URL", None), ("DUPLICADO_CONTENIDO", None), ("DUPLICADO_CONTENIDO", None), ("REVISITADO", None)]


def stateful(events, cap=3):
    s = {}
    for key, kind, depth, origin in events:
        if kind == "registrar":
            old = s.get(key)
            s[key] = [depth, origin or (old[1] if old else None), "pendiente", 0]
        elif key in s:
            if kind == "visitada":
                s[key][2] = "visitada"
            else:
                s[key][3] += 1
                s[key][2] = "error" if s[key][3] < cap else "visitada"
    return {k: tuple(v) for k, v in s.items()}


@pytest.mark.parametrize("seed", range(5))
def test_frontier_fold(spark, seed):
    r = random.Random(seed)
    events = [(f"k{r.randrange(5)}", r.choice(["registrar", "visitada", "error", "error"]), r.randrange(4), r.choice([None, "a", "b"])) for _ in range(60)]
    df = spark.createDataFrame([(k, i, t, k, d, o) for i, (k, t, d, o) in enumerate(events)], "clave string, orden long, tipo string, url string, profundidad int, url_origen string")
    got = {x.clave: (x.profundidad, x.url_origen, x.estado, x.intentos) for x in frontier.fold(df).collect()}
    assert got == stateful(events)


def test_queue_order(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "B", 1, "pendiente", 0), (2, "A", 0, "pendiente", 0), (3, "D", 1, "error", 2), (4, "C", 0, "pendiente", 0), (5, "E", 0, "error", 3), (6, "F", 0, "visitada", 0)]
    df = spark.createDataFrame([(i, u, u, p, -float(p), None, e, n, t) for i, u, p, e, n in rows] + [(2, "A", "A", 0, 0.0, None, "visitada", 0, dt.datetime(2023, 1, 1))], "id long, hash_url string, url string, profundidad int, prioridad double, url_origen string, estado string, intentos int, actualizada_en timestamp")
    assert [r.url for r in frontier.eligible(frontier.current(df)).collect()] == ["A", "C", "B", "D"]
    docs = spark.createDataFrame([("A", dt.datetime(2025, 1, 1)), ("B", dt.datetime(2020, 1, 1))], "hash_url string, fecha_revisitacion timestamp")
    got = frontier.reconcile(frontier.current(df), docs, F.lit(t)).where("descartada").collect()
    assert [r.hash_url for r in got] == ["A"] and got[0].estado == "visitada"


def test_crawl_levels(spark):
    chain = [(f"http://a.com/{i}", f"http://a.com/{i + 1}") for i in range(9)] + [("http://a.com/0", "http://a.com/x.pdf"), ("http://a.com/1", "http://a.com/0"), ("http://a.com/0", None)]
    out = frontier.crawl(spark.createDataFrame([("http://a.com/0",)], "url string"), spark.createDataFrame(chain, "url string, enlace string"))
    assert {(r.url[-1], r.profundidad) for r in out.collect()} == {(str(i), i) for i in range(5)}


def test_page_actions(spark):
    rows = [(False, 200, True, [], False, None), (True, 500, True, [], False, None), (True, None, True, [], False, None), (True, 301, True, [], False, None), (True, 200, False, [], False, None), (True, 200, True, ["none"], False, None), (True, 200, True, [], True, None), (True, 200, True, [], False, "densidad"), (True, 200, True, ["nofollow"], False, None)]
    df = spark.createDataFrame([(*r, "ALMACENADO") for r in rows], "permitido boolean, codigo_http int, es_html boolean, directivas array<string>, es_hub boolean, rechazo string, tienda string")
    got = [(r[0], r[1]) for r in df.select(frontier.page_action(), frontier.follows_links()).collect()]
    assert [g[0] for g in got] == ["BLOQUEADO_ROBOTS", "ERROR", "ERROR", None, "NO_HTML", "NOINDEX", None, "BAJA_DENSIDAD", "ALMACENADO"]
    assert [g[1] for g in got] == [True] * 5 + [False, True, True, False]


def test_delay_is_the_sequential_fold(spark):
    r = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    log = [("h", i, base + dt.timedelta(minutes=7 * i), r.uniform(10, 30000), r.choice([200, 200, 429, 503, None])) for i in range(200)]
    d = 0.75
    for _, _, _, ms, code in log:
        d = min(5.0, max(0.75, (d + (2 * d if code in acquisition.RETRY_CODES else ms / 2000)) / 2))
    df = spark.createDataFrame(log, "dominio string, id long, instante timestamp, tiempo_respuesta_ms double, codigo_http int")
    got = acquisition.adaptive_delay(df).first()
    assert got.demora == pytest.approx(d, abs=1e-9) and got.respuestas == 200
    assert acquisition.adaptive_delay(df.limit(0)).count() == 0


def test_reports(spark):
    docs = spark.createDataFrame([("a", 10), ("a", 20), (None, 5)], "dominio string, bytes long")
    assert {(r.dominio, r.documentos, r.bytes) for r in reports.by_domain(docs).collect()} == {("a", 2, 30), ("(desconocido)", 1, 5), ("TOTAL", 3, 35)}
    ranked = reports.word_frequency(spark.createDataFrame([("Él y él. b b",), (None,), ("",)], "texto string"))
    assert [(r.rango, r.palabra, r.frecuencia) for r in ranked.orderBy("rango").collect()] == [(1, "b", 2), (2, "él", 2), (3, "y", 1)]
    assert reports.hapax(ranked).first().hapax == 1


def test_seeds(spark, tmp_path):
    f = tmp_path / "s.txt"
    f.write_text("# nota\nhttps://a.com/x\nhttps://A.com/x # repetida\n\nhttps://www.b.org/\n")
    got = seeds.read_seeds(spark, str(f)).orderBy("linea").collect()
    assert [(r.linea, r.semilla, r.host) for r in got] == [(2, "https://a.com/x", "a.com"), (5, "https://www.b.org/", "b.org")]
    f.write_text("https://a.com\nno es\n")
    with pytest.raises(ValueError, match="line 2"):
        seeds.read_seeds(spark, str(f))
    f.write_text("# nada\n")
    with pytest.raises(ValueError):
        seeds.read_seeds(spark, str(f))
    (tmp_path / "r" / "d").mkdir(parents=True)
    (tmp_path / "r" / "d" / "x.txt").write_bytes(b"a\xff\xc3\xb1")
    assert [r.texto for r in seeds.read_repository(spark, str(tmp_path / "r")).collect()] == ["a�ñ"]


def test_store_stream(spark, tmp_path):
    """Two batches through a stream, the second run twice as after a failure."""
    schema = "secuencia long, hash_url string, hash_contenido string, ruta_relativa string, fecha timestamp"
    batches = [[(0, "u1", "c1", "p1"), (1, "u2", "c1", "p2")], [(2, "u1", "c5", "p5"), (3, "u3", "c3", "p3")]]
    sink = StoreStream(spark, str(tmp_path / "s"))
    (tmp_path / "s").mkdir()
    (tmp_path / "in").mkdir()
    for n, b in enumerate(batches):
        spark.createDataFrame([(*r, dt.datetime(2024, 1, 1 + n)) for r in b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = sink.decided[-1]
    sink(spark.createDataFrame([(*r, dt.datetime(2024, 1, 2)) for r in batches[1]], schema), last)
    got = list(itertools.chain(*[[(r.secuencia, r.accion) for r in spark.read.parquet(str(tmp_path / "s" / f"decisions-{n}")).collect()] for n in sorted(set(sink.decided))]))
    assert sorted(got) == [(0, "ALMACENADO"), (1, "DUPLICADO_CONTENIDO"), (2, "DUPLICADO_URL"), (3, "ALMACENADO")]
    assert {r.hash_url for r in sink.state().collect()} == {"u1", "u3"}


def test_action_counts(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/bitacora_recorrido.parquet")
    counted = action_counts(log)
    assert counted.agg(F.sum("n")).first()[0] == log.where("instante is not null").count()


def small_ranges(spark, on):
    for key in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.enabled"):
        spark.conf.set(key, "false" if on else "true")


def test_retries_over_ranges(spark):
    """One address holds most rows and is split over ranges; attempts must be counted as if it stood in one."""
    r = random.Random(3)
    rows = [(i, "u" if i % 8 else (None, "v", "w")[i // 8 % 3], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(4000)), r.choice((503, 503, 503, None, 200, 404))) for i in range(1200)]
    rows += [(9000 + i, "z", dt.datetime(2024, 2, 1, 0, i), 503) for i in range(50)]
    streak, want = {}, {}
    for i, url, at, code in sorted(rows, key=lambda x: (x[1] or "", x[2], x[0])):
        key = (url, at.date())
        streak[key] = streak.get(key, 0) + 1
        again = code is None or code in acquisition.RETRY_CODES
        n = streak[key]
        want[i] = (n, "reintento" if again and n <= 3 else "agotado" if again else "definitivo" if code >= 400 else "ok")
        if not again:
            streak[key] = 0
    df = spark.createDataFrame(rows, "id long, url_destino string, instante timestamp, codigo_http int")
    small_ranges(spark, True)
    try:
        got = acquisition.retries(df).collect()
    finally:
        small_ranges(spark, False)
    assert {x.id: (x.intento, x.resultado) for x in got} == want and len(got) == len(rows)


def test_slots_over_ranges(spark):
    r = random.Random(4)
    rows = [(i, "hot" if i % 10 else "b", dt.datetime(2024, 1, 1, 23, 50) + dt.timedelta(milliseconds=r.randrange(900_000)), float(r.choice((10, 900, 4000, 90_000)))) for i in range(1500)] + [(9000, None, dt.datetime(2024, 1, 1), 1.0), (9001, "b", None, 1.0)]
    want = {}
    for host in ("hot", "b"):
        last, ends = None, []
        for i, h, at, ms in sorted((x for x in rows if x[1] == host and x[2]), key=lambda x: (x[2], x[0])):
            t = int((at - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 + 0.5)
            start = t if last is None else max(t, last + 750_000)
            last = start
            want[i] = (start, sum(e > start for e in ends))
            ends.append(start + round(min(45_000, ms) * 1000))
    df = spark.createDataFrame(rows, "id long, dominio string, instante timestamp, tiempo_respuesta_ms double")
    small_ranges(spark, True)
    try:
        got = acquisition.slots(df).collect()
    finally:
        small_ranges(spark, False)
    assert {x.id: (x.turno, x.activas) for x in got} == want and all(x.libre == (x.activas < 4) for x in got)


@pytest.mark.parametrize("open_rows", [0, 1, 10_000])
def test_chains_of_conflicts(spark, monkeypatch, open_rows):
    """Addresses and contents that conflict in turn; by rounds, by rounds and one task, by one task."""
    monkeypatch.setattr(store, "ONE_BY_ONE", open_rows)
    rows = [(i, f"u{(i + 1) // 2}", f"c{i // 2}", "r") for i in range(9)] + [(20, "u0", "c9", "r"), (21, "u9", "c9", "r")]
    urls_, contents, want = set(), set(), {}
    for i, u, c, _ in rows:
        want[i] = store.SAME_URL if u in urls_ else store.SAME_CONTENT if c in contents else store.STORED
        if want[i] == store.STORED:
            urls_.add(u)
            contents.add(c)
    df = spark.createDataFrame(rows, "secuencia int, hash_url string, hash_contenido string, ruta_relativa string")
    none = spark.createDataFrame([], "hash_url string, hash_contenido string, ruta_relativa string, fecha_revisitacion timestamp")
    assert {x.secuencia: x.accion for x in store.decide(df, none, F.lit(dt.datetime(2024, 1, 1))).collect()} == want


def test_schema_and_commands(spark, tmp_path, capsys):
    from tesela.__main__ import main

    (tmp_path / "semillas.txt").write_text("https://a.example/ # uno\nhttps://www.b.example/x\n")
    for created in (True, False):
        assert {r.creada for r in store.bootstrap(spark, f"file://{tmp_path}/almacen").collect()} == {created}
    assert main(["verificar", str(tmp_path / "semillas.txt"), f"file://{tmp_path}/almacen"]) == 0
    out = capsys.readouterr().out
    assert "seeds: 2" in out and "b.example" in out and "documents: 0" in out
    with pytest.raises(SystemExit) as e:
        main(["--version"])
    assert e.value.code == 0
