"""Terms, leaks, mixing and splitting on small fixtures."""

import hashlib
import itertools
import math
import random
import subprocess
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesela.llm import leaks, mixing, splitting, state, terms
from tesela.llm.tokens import encoding
from tesela.operators import joins


# -- joins -----------------------------------------------------------------------------------
def test_joins_stay_whole(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1)], "k string, v long")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k9", 3)], "k string, w long")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, joins.bounded_join(left, right, ["k"], "v", limit=0).collect())) == want  # salted
    assert sorted(map(tuple, joins.bounded_join(left, right, ["k"], "v").collect())) == want  # broadcast
    sizes = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    got = joins.skew_join(left, sizes, "k", "n", 3000, "v")
    assert {(r.k, r.n) for r in got.collect()} == {(r.k, r.n) for r in left.join(sizes, "k", "left").collect()} and got.count() == 3001


# -- 3, 5 ------------------------------------------------------------------------------------
POSTINGS = [("cine", 1, 0, 2), ("cine", 1, 0, 2), ("cine", 2, 0, 1), ("peliculon", 1, 0, 5), ("peliculon", 3, 1, 4), ("raro", 3, 1, 1), (None, 3, 1, 4), ("nulo", None, 0, 4), ("cero", 2, 0, None), ("cero", 2, 0, 0)]


def postings(spark, rows=POSTINGS):
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], "termino string, doc_id long, bloque int, tf int, peso_tfidf double, n_t string")


def test_ppmi_against_brute_force(spark):
    r = random.Random(1)
    rows = [(f"t{r.randrange(20)}", d, 0, r.randrange(1, 6)) for d in range(30) for _ in range(8)]
    tf = {}
    for t, d, _, n in rows:
        tf[t, d] = max(n, tf.get((t, d), 0))
    by_t, by_d = Counter(), Counter()
    for (t, d), n in tf.items():
        by_t[t] += n
        by_d[d] += n
    z = sum(v**0.75 for v in by_d.values())
    total = sum(tf.values())
    for row in terms.ppmi(postings(spark, rows)).collect():
        n = tf[row.termino, row.doc_id]
        want = max(0.0, math.log2((n / total) / ((by_t[row.termino] / total) * (by_d[row.doc_id] ** 0.75 / z))))
        assert row.tf == n and row.ppmi == pytest.approx(want, abs=1e-9)
    assert terms.ppmi(postings(spark, rows)).count() == len(tf)


def test_p3_found(spark):
    assert sorted(tuple(r) for r in terms.p3_found(postings(spark)).collect()) == [(1, "peliculon"), (3, "peliculon")]
    assert terms.p3_found(postings(spark).limit(0)).count() == 0


def test_p5_found(spark):
    docs = spark.createDataFrame([(i, "x") for i in (1, 2, 3, 4, 5)] + [(None, "x")], "doc_id long, texto string")
    want = {"cine": (3, 2, "comun"), "peliculon": (9, 2, "comun"), "raro": (1, 1, "raro")}
    for build in (terms.p5_counts, terms.p5_by_blocks):
        assert {r.termino: (r.ocurrencias, r.registros, r.marca) for r in build(postings(spark), docs).collect()} == want
    assert {tuple(r) for r in terms.p5_found(postings(spark), docs).collect()} == {("cine", "comun"), ("peliculon", "comun"), ("raro", "raro")}
    assert terms.p5_counts(postings(spark).limit(0), docs).count() == 0 and terms.p5_by_blocks(postings(spark).limit(0), docs).count() == 0


def test_signed_deltas(spark):
    """Changed and deleted records, against counting afresh."""
    old = [("a", 1, 0, 2), ("b", 1, 0, 1), ("a", 2, 0, 1), ("c", 3, 0, 4)]
    removed, added = [("a", 1, 0, 2), ("b", 1, 0, 1), ("c", 3, 0, 4)], [("a", 1, 0, 7), ("d", 1, 0, 1)]
    held = terms.merge_terms(terms.term_counts(spark), terms.signed_delta(postings(spark, old)))
    held = terms.merge_terms(held, terms.signed_delta(postings(spark, added), postings(spark, removed)))
    assert {r.termino: (r.ocurrencias, r.registros) for r in held.read().collect()} == {"a": (8, 2), "d": (1, 1)}


def test_only_touched_partitions_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PARTITION_ROWS", 10)
    path = f"file://{tmp_path}/terminos"
    rows = [(f"t{i}", i, 0, 1) for i in range(80)]
    one = terms.merge_terms(terms.term_counts(spark, path), terms.signed_delta(postings(spark, rows)))
    assert len(one.parts) == 8 and sum(one.sizes) == 80
    two = terms.merge_terms(one, terms.signed_delta(postings(spark, [("t3", 500, 0, 2)])), "lote")
    assert sorted(two.parts) == [0] * 7 + [1] and sum(two.sizes) == 80
    gone = terms.merge_terms(two, terms.signed_delta(None, postings(spark, rows[:40])))
    assert {r.termino: r.registros for r in gone.read().collect()} == {"t3": 1} | {f"t{i}": 1 for i in range(40, 80)}
    many = terms.merge_terms(gone, terms.signed_delta(postings(spark, [(f"u{i}", i, 0, 1) for i in range(400)])))
    assert len(many.parts) == 45 and many.read().count() == 441  # dealt anew
    assert terms.term_counts(spark, path, 0).read().count() == 80 and state.versions(spark, path) == [0, 1, 2, 3]
    many.drop_before()
    assert state.versions(spark, path) == [3] and many.read().count() == 441
    with pytest.raises(ValueError):
        terms.term_counts(spark, path, 0)


SESSION = """
import sys
from tesela.llm import terms
from tesela.session import get_spark
spark = get_spark("state", "local[2]", 2)
path, rows = sys.argv[1], [r.split(",") for r in sys.argv[2:]]
df = spark.createDataFrame([(t, int(d), int(n)) for t, d, n in rows], "termino string, doc_id long, tf int")
held = terms.merge_terms(terms.term_counts(spark, path), terms.signed_delta(df), batch=sys.argv[2])
print("counts", sorted(tuple(r) for r in held.read().collect()))
"""


def test_state_outlives_the_session(tmp_path):
    """A second program, with a session of its own, merges its delta into what the first one left; a delta sent twice counts once."""
    run = lambda *rows: subprocess.run([sys.executable, "-c", SESSION, f"file://{tmp_path}/t", *rows], capture_output=True, text=True, check=True, timeout=300).stdout
    assert "counts [('a', 2, 1), ('b', 1, 1)]" in run("a,1,2", "b,1,1")
    for _ in range(2):
        assert "counts [('a', 5, 2), ('b', 1, 1), ('c', 4, 1)]" in run("a,2,3", "c,2,4")


# -- 8 ---------------------------------------------------------------------------------------
def distance(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    r = random.Random(5)
    for _ in range(300):
        p = [r.choice("abcd") for _ in range(r.randrange(1, 13))]
        t = [r.choice("abcd") for _ in range(r.randrange(0, 20))]
        d = distance(p, t)
        assert leaks.myers(p, t, 2) == (d if d <= 2 else 3)


WORDS = [f"w{i:03d}" for i in range(400)]


def test_pigeonhole_finds_every_close_window():
    r = random.Random(7)
    items = [(i, r.sample(WORDS, 30)) for i in range(12)] + [(99, ["corto"] * 4)]
    matcher = leaks.Matcher(items)
    for _ in range(60):
        n = r.randrange(12)
        o = r.randrange(0, 19)
        piece = items[n][1][o : o + 12]
        for _ in range(r.randrange(0, 3)):
            k = r.randrange(len(piece))
            piece = [piece[:k] + ["nuevo"] + piece[k + 1 :], piece[:k] + piece[k + 1 :], piece[:k] + ["otro"] + piece[k:]][r.randrange(3)]
        text = r.sample(WORDS, 20) + piece + r.sample(WORDS, 20)
        want = {i for i, w in items if len(w) >= 12 and any(distance(w[a : a + 12], text) <= 2 for a in range(len(w) - 11))}
        assert {m["item_id"] for m in matcher.match(" ".join(text))} == want


def edited(r, piece, edits):
    for _ in range(edits):
        k = r.randrange(len(piece))
        piece = [piece[:k] + ["nuevo"] + piece[k + 1 :], piece[:k] + piece[k + 1 :], piece[:k] + ["otro"] + piece[k:]][r.randrange(3)] or ["vacio"]
    return piece


def test_leaks_against_brute_force(spark):
    """Every pair of item and text by plain edit distances: long items by windows, items of under 12 words as a whole; by automaton and by join."""
    r = random.Random(11)
    items = [(i, r.sample(WORDS, n)) for i, n in enumerate((30, 12, 13, 11, 8, 6, 5, 3, 1, 14))]
    texts = []
    for k in range(50):
        n, w = items[k % len(items)]
        size = min(12, len(w))
        o = r.randrange(len(w) - size + 1)
        texts.append((k, r.sample(WORDS[200:], 15) + edited(r, w[o : o + size], r.randrange(0, 4)) + r.sample(WORDS[200:], 15)))
    texts.append((90, items[1][1][:11]))
    want = {}
    for d, t in texts:
        for i, w in items:
            size = min(12, len(w))
            best = min(distance(w[o : o + size], t) for o in range(len(w) - size + 1))
            if best <= size * 2 // 12:
                want[i, d] = best
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string")
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(70, ""), (71, "...")], "item_id long, texto string")
    got = leaks.leaks(docs, held).collect()
    assert {(m.item_id, m.doc_id): m.distancia for m in got} == want and len(got) == len(want)
    joined = leaks.leaks(docs, held, limit=3).collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, got))
    assert {(m.item_id, m.doc_id): m.distancia for m in leaks.p8_edited(docs, held).collect()} == {k: v for k, v in want.items() if v}
    assert leaks.leaks(docs.limit(0), held, limit=3).count() == 0 and leaks.leaks(docs, held.limit(0), limit=-1).count() == 0


def test_p8_found(spark):
    item = "En la tercera bobina Ana Ñuñez cruza el puente de Lugo con un paraguas roto mientras cuenta"
    items = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, "muy corto", "x"), (3, None, "x"), (None, item, "x")], "item_id long, texto string, distancia string")
    exact = "antes " + item.upper().replace("Ñ", "N").replace(" CON", ", CON") + " después"
    eleven = " ".join(item.split()[:11]) + " y se acabó"
    near = item.replace("puente", "río")
    docs = spark.createDataFrame([(10, exact), (11, eleven), (12, near), (13, None), (14, ""), (15, "x " * 5000 + item), (15, "x " * 5000 + item), (None, item)], "doc_id long, text string")
    got = leaks.p8_found(docs, items)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(1, 10), (1, 15), (1, None)], key=repr)
    found = {r.doc_id: r for r in leaks.leaks(docs, items).collect()}
    assert found[12].distancia == 1 and found[12].corrida < 12 and found[10].distancia == 0 and found[10].proporcion == 1.0 and 11 in found
    assert leaks.p8_found(docs.limit(0), items).count() == 0 and leaks.p8_found(docs, items.limit(0)).count() == 0


# -- 9 ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(40))
def test_budget_is_met_exactly_where_it_can_be(seed):
    r = np.random.default_rng(seed)
    lengths = np.sort(r.choice(np.arange(2, 30), size=6, replace=False))
    counts = r.integers(1, 5, size=6)
    total, budget, cap = int((lengths * counts).sum()), int(r.integers(0, 400)), int(r.integers(1, 4))
    full, take = mixing.fit_budget(lengths, counts, budget, cap)
    used = full * total + int((lengths * take).sum())
    assert (take >= 0).all() and (take <= counts).all() and used <= budget and full + (take > 0).any() <= cap
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    rest = budget - full * total
    want = full * total + (max(s for s in sums if s <= rest) if full < cap else 0)
    assert used == want


def test_mixture(spark):
    text = lambda n: " ".join(["casa"] * n)
    docs = [(i, text(5 + i % 40), ("a", " A ", "A")[i % 3], "x") for i in range(200)] + [(1000 + i, text(8), "b", "x") for i in range(30)]
    docs += [(2000, None, "a", "x"), (2001, "", "b", "x"), (2002, "hola", None, "x"), (2003, "hola", "c", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("z", 0.2, 2)], "fuente string, peso_objetivo double, max_repeticiones int")
    chosen, shares = mixing.mixture(df, targets)
    rows = chosen.collect()
    share = {r.fuente: r for r in shares.collect()}
    used = defaultdict(int)
    for r in rows:
        used[r.fuente] += r.n_tokens * r.repeticiones
        assert 1 <= r.repeticiones <= {"a": 1, "b": 3}[r.fuente]
    assert {k: v.tokens for k, v in share.items()} == {"a": used["a"], "b": used["b"], "z": 0}
    assert share["a"].proporcion == pytest.approx(0.5 / 0.8, abs=0.01) and share["b"].proporcion == pytest.approx(0.3 / 0.8, abs=0.01) and share["z"].proporcion == 0
    assert max(r.repeticiones for r in rows if r.fuente == "b") == 3 and len({r.doc_id for r in rows}) == len(rows)
    again = mixing.mixture(df.repartition(7), targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert sorted(map(tuple, mixing.mixture(df, targets, seed=7)[0].collect())) != sorted(map(tuple, rows))
    assert mixing.mixture(df, targets, total_tokens=1000)[1].agg(F.sum("tokens")).first()[0] == pytest.approx(1000, abs=12)
    none, empty = mixing.mixture(df.limit(0), targets)
    assert none.count() == 0 and {r.tokens for r in empty.collect()} == {0}
    assert mixing.mixture(df, targets.limit(0))[0].count() == 0


def test_hot_lengths_are_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 20)
    df = spark.createDataFrame([(i, "casa de campo", "a") for i in range(500)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "fuente string, peso_objetivo double, max_repeticiones int")
    n = mixing.mixture(df, targets)[0].first().n_tokens
    chosen = mixing.mixture(df, targets, total_tokens=n * 123)[0]
    assert chosen.count() == 123 and chosen.select("doc_id").distinct().count() == 123


# -- 10 --------------------------------------------------------------------------------------
ENCODE = splitting._Encode(splitting.VOCABULARY)
TEXTS = {
    "prosa": " ".join(f"La escena número {i} trata de {['barcos', 'trenes', 'volcanes'][i // 40 % 3]} y de gente." for i in range(160)),
    "escenas": "\n".join(f"INT. CASA {i} - NOCHE\n" + "Alguien entra y dice algo que nadie oye. " * 6 for i in range(20)),
    "sin_espacios": ";".join(f"palabra{i}" for i in range(900)),
    "una_palabra": "añ" * 3000,
    "emoji": "🎬🎞️" * 700,
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_pieces(name):
    text, limit, overlap = TEXTS[name], 256, 32
    parts = splitting.split_text(text, ENCODE, limit, overlap)
    assert len(parts) > 1 and parts[0]["inicio"] == 0 and parts[-1]["fin"] == len(text)
    assert "".join(text[p["corte"] : p["fin"]] for p in parts) == text
    for a, b in itertools.pairwise(parts):
        assert b["corte"] == a["fin"]
        repeated = len(ENCODE(text[b["inicio"] : b["corte"]]))
        assert overlap <= repeated <= overlap + 4
    for p in parts:
        assert p["n_tokens"] == len(ENCODE(text[p["inicio"] : p["fin"]])) <= limit
    level = {"prosa": "oracion", "escenas": "escena", "sin_espacios": "palabra", "una_palabra": "caracter", "emoji": "caracter"}[name]
    assert {p["nivel"] for p in parts[:-1]} == {level} if name != "emoji" else True


def test_cut_at_topic_change():
    a, b = "El barco navega por el mar con su capitán y sus marineros. ", "La cocina prepara verduras con aceite, harina y mantequilla. "
    text = a * 14 + b * 20
    parts = splitting.split_text(text, ENCODE, 300, 16)
    assert abs(parts[0]["fin"] - len(a) * 14) <= 2


def test_cuts_go_to_planted_topics():
    """Topics of uneven length, each of words of its own: cuts at the topic ends wherever a window holds one."""
    random.seed(4)
    stock = [[f"{x}{''.join(random.choices('abcdefghij', k=5))}" for _ in range(14)] for x in "pqrstuvwxyzk"]
    text, ends = "", []
    for words in stock:
        for _ in range(random.randint(6, 8)):
            text += " ".join(random.choices(words, k=7)).capitalize() + ". "
        ends.append(len(text))
    parts = splitting.split_text(text, ENCODE, 700, 16)
    assert len(parts) > 3 and all(min(abs(p["fin"] - e) for e in ends) <= 1 for p in parts)  # a token holds the blank before it


def test_valleys_against_brute_force():
    random.seed(5)
    words = [f"palabra{chr(97 + i)}" for i in range(12)]
    text = "".join(" ".join(random.choices(words[i // 9 % 3 * 3 :][:6], k=5)) + ". " for i in range(60))
    gaps = [m.end() for m in splitting._SENTENCE.finditer(text)]
    bags = [Counter(splitting._TERM.findall(text[a:b].lower())) for a, b in zip([0, *gaps], [*gaps, len(text)])]
    n, k = len(gaps), splitting.BLOCK
    blocks = [(sum(bags[max(0, i - k + 1) : i + 1], Counter()), sum(bags[i + 1 : i + 1 + k], Counter())) for i in range(n)]
    norm = lambda c: math.sqrt(sum(v * v for v in c.values()))
    sims = [sum(v * b[w] for w, v in a.items()) / (norm(a) * norm(b)) if a and b else 0.0 for a, b in blocks]

    def peak(i, step):
        best = sims[i]
        while 0 <= i + step < n and sims[i + step] >= sims[i]:
            i += step
            best = sims[i]
        return best

    want = [peak(i, -1) + peak(i, 1) - 2 * sims[i] for i in range(n)]
    assert np.allclose(splitting.valley_depths(text, gaps), want)


def test_time_grows_with_the_text():
    random.seed(6)
    words = ["".join(random.choices("abcdefghijklmn", k=6)) for _ in range(30_000)]
    text = "".join(" ".join(random.choices(words, k=11)) + ". " for _ in range(8_000))
    took = []
    for t in (text[: len(text) // 4], text):
        best = math.inf
        for _ in range(2):
            began = time.perf_counter()
            parts = splitting.split_text(t, ENCODE)
            best = min(best, time.perf_counter() - began)
        took.append(best)
        assert "".join(t[p["corte"] : p["fin"]] for p in parts) == t
    assert took[1] < 8 * took[0]  # four times the text; a quadratic run takes sixteen times


def test_small_texts_are_kept_on_demand(spark):
    df = spark.createDataFrame([(1, "corto"), (2, "palabra " * 5000), (3, None), (4, "")], "doc_id long, text string")
    rows = splitting.pieces(df, keep_small=True).collect()
    assert {(r.doc_id, r.piezas) for r in rows if r.doc_id != 2} == {(1, 1), (4, 1)} and {r.doc_id for r in splitting.pieces(df).collect()} == {2}
    got = {r.doc_id: r for r in splitting.p10_reunited(df).collect()}
    want = {i: hashlib.md5(t.encode()).hexdigest() for i, t in ((1, "corto"), (2, "palabra " * 5000), (4, ""))}
    assert {i: r.huella for i, r in got.items()} == want and all(r.en_limite and r.solapan for r in got.values())


def test_p10_found(spark):
    big = "palabra " * 5000
    df = spark.createDataFrame([(1, "corto", "x"), (2, big, "x"), (2, big, "x"), (3, None, "x"), (4, "", "x"), (None, big, "x"), (5, "ñ" * 4000, "x")], "doc_id long, text string, pieza string")
    assert sorted((r.doc_id for r in splitting.p10_found(df).collect()), key=repr) == sorted([2, 2, None], key=repr) or len(encoding().encode_ordinary("ñ" * 4000)) > 4096
    rows = splitting.pieces(df.where("doc_id = 2").limit(1)).orderBy("pieza").collect()
    assert all(r.n_tokens <= 4096 for r in rows) and rows[0].piezas == len(rows)
    assert splitting.p10_found(df.limit(0)).count() == 0


def test_distinct_lengths_are_taken_alike():
    """One document a length: short, middling and long ones get the same share, other ones with another seed."""
    lengths = np.arange(10, 3010)
    ones = np.ones(len(lengths), dtype=np.int64)
    for share in (0.3, 0.5, 0.8):
        budget = int(lengths.sum() * share)
        full, take = mixing.fit_budget(lengths, ones, budget, 1)
        assert full == 0 and int((lengths * take).sum()) == budget and take.max() == 1
        assert all(abs(take[i : i + 600].mean() - share) < 0.02 for i in range(600, 3000, 600))  # the shortest also fill the reserve
    other = mixing.fit_budget(lengths, ones, int(lengths.sum() * 0.5), 1, seed=8)[1]
    assert (mixing.fit_budget(lengths, ones, int(lengths.sum() * 0.5), 1)[1] != other).mean() > 0.1
    huge = np.array([50_000, 90_000, 130_000])
    for seed in range(20):
        for budget in (60_000, 100_000, 200_000, 269_000):
            take = mixing.fit_budget(huge, np.ones(3, dtype=np.int64), budget, 1, seed)[1]
            assert (take >= 0).all() and (take <= 1).all() and int((huge * take).sum()) <= budget


def largest_sum(lengths, counts, budget):
    sums = 1
    for n, k in zip(lengths.tolist(), counts.tolist()):
        for _ in range(k):
            sums |= sums << n
    return (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1


@pytest.mark.parametrize("seed", range(12))
def test_budgets_are_met_as_near_as_can_be(seed):
    """Below, at and beyond the reserve, with lengths that share a divisor, rare lengths and documents longer than the reserve."""
    r = np.random.default_rng(seed)
    long = mixing.RESERVE
    cases = [
        (r.integers(3, 400, 40), r.integers(1, 6, 40)),
        (r.integers(1, 60, 9) * 14, r.integers(5, 60, 9)),  # a common divisor
        (np.r_[r.integers(30, 600, 12) * 2, 1001], np.r_[r.integers(20, 60, 12), 1]),  # one odd document
        (r.integers(long // 2, 3 * long, 6), r.integers(1, 4, 6)),  # few long ones
    ]
    for lengths, counts in cases:
        lengths, at = np.unique(lengths, return_index=True)
        counts = counts[at]
        total = int((lengths * counts).sum())
        for budget in {long - 1, long, long + 1, total // 3, total // 2 + 1, total - 1}:
            full, take = mixing.fit_budget(lengths, counts, int(min(budget, total - 1)), 3, seed)
            got = int((lengths * take).sum())
            assert full == 0 and (take >= 0).all() and (take <= counts).all()
            assert got == largest_sum(lengths, counts, int(min(budget, total - 1)))


def test_huge_budgets_are_met():
    lengths = np.arange(5, 6000, 7)
    counts = np.full(len(lengths), 3_000_000)
    total = int((lengths * counts).sum())
    for budget in (total // 3 + 1, 2 * total // 3 + 5, 5 * total // 2 + 11):
        full, take = mixing.fit_budget(lengths, counts, budget, 4)
        assert full == budget // total and full * total + int((lengths * take).sum()) == budget


def test_p9_gaps(spark):
    docs = spark.createDataFrame([(i, "casa " * (1 + i * 7 % 97), "a" if i % 3 else " B ") for i in range(120)] + [(500, None, "a")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 3), ("z", 0.25, 2)], "fuente string, peso_objetivo double, max_repeticiones int")
    got = {r.fuente: r for r in mixing.p9_gaps(docs, targets).collect()}
    assert [round(got[k].objetivo, 6) for k in "abz"] == [0.666667, 0.333333, 0.0] and [got[k].documentos for k in "abz"] == [80, 40, 0]
    assert all(r.cumple and r.en_limite for r in got.values())
