"""Language of documents and of the lines of mixed documents by a linear-chain CRF.

Words are labelled with one of six languages. Features of a word are its
identity, prefixes, suffixes, character n-grams and membership in closed
lexicons; transitions are learned separately within a line and across a line
end. Posterior marginals come from forward-backward and are summed per line
and per document: the largest share is the language, the share its confidence.

The model is fitted when the operator is built, on a bounded sample of labelled
rows (``TrainingBound``); the labels are noisy, so a line whose grammatical
words clearly speak for another language takes that one.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines as L
from .arrow import map_rows, nested
from .lexicon import LANGUAGES, function_sets

K = len(LANGUAGES)
_FUNCTION = function_sets()
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"[^\W\d_]+|\n")
_ADDRESS = re.compile(r"\S*://\S+")

#: Notations of the languages (lower case, before any ``-`` or ``_``). FIXED VALUES.
NOTATIONS = {
    "es": "es spa esp español espanol spanish castellano",
    "en": "en eng english inglés ingles",
    "pt": "pt por português portugues portuguese",
    "fr": "fr fra fre français francais french francés",
    "it": "it ita italiano italian",
    "de": "de deu ger deutsch german alemán aleman",
}

#: Characters from which a line is sizable.
LINE_CHARS = 60
#: Words in lower case a sizable line needs to count as a line of a language; words that one in capitals needs.
LINE_WORDS = 3
CAPITAL_WORDS = 5
#: Words of a block; the blocks of a text run side by side and hand their messages over exactly (no effect on results).
BLOCK_WORDS = 256
#: Rows read for every training row wanted; some are too short to train on.
OVERSAMPLE = 3
LEAST_SAMPLE_CHARS = 200
#: Entries of a worker's memo of word scores; it is emptied when full (no effect on results).
MEMO = 200_000


@dataclass(frozen=True)
class TrainingBound:
    """Bound of the labelled sample: at most ``rows`` texts a language and table, ``words`` words of each."""

    rows: int = 120
    words: int = 160
    iterations: int = 45
    l2: float = 0.02


def declared_language(label: Column) -> Column:
    """One of the six codes, or null for missing, blank and unknown labels."""
    head = F.split(F.lower(F.trim(label)), "[-_]")[0]
    out = F.lit(None).cast("string")
    for code, names in NOTATIONS.items():
        out = F.when(head.isin(*names.split()), F.lit(code)).otherwise(out)
    return out


def word_features(word: str) -> list[str]:
    """Identity, affixes, inner n-grams and lexicons of a word."""
    w = word.lower()
    out = [f"w={w}", f"c={word[:1].isupper()}"]
    out += [f"x={lang}" for lang in LANGUAGES if w in _FUNCTION[lang]]
    for n in (1, 2, 3, 4):
        if len(w) > n:
            out.append(f"s={w[-n:]}")
            if n > 1:
                out.append(f"p={w[:n]}")
    b = f"^{w}$"
    out += [f"n={b[i : i + 3]}" for i in range(len(b) - 2)]
    out += [f"n={b[i : i + 2]}" for i in range(len(b) - 1)]
    return out


def lexicon_language(words: list[str], least: int = 2) -> int | None:
    """Language whose grammatical words clearly lead, else None."""
    votes = sorted(((sum(1 for w in words if w in _FUNCTION[lang]), i) for i, lang in enumerate(LANGUAGES)), reverse=True)
    return votes[0][1] if votes[0][0] >= least and votes[0][0] >= 1.5 * votes[1][0] else None


class Crf:
    """Weights of a fitted chain; ``fit`` trains it, ``marginals`` runs forward-backward."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, within: np.ndarray, across: np.ndarray):
        self.features, self.weights, self.within, self.across = features, weights, within, across

    # -- forward-backward over a batch --------------------------------------------------------
    @staticmethod
    def _run(emission: np.ndarray, breaks: np.ndarray, sizes: np.ndarray, within: np.ndarray, across: np.ndarray, pairs: bool, start: np.ndarray | None = None, end: np.ndarray | None = None):
        """Marginals (T, B, K) of emissions (T, B, K); with ``pairs`` also expected transition counts.

        Sequences are sorted by falling size, so those alive at a step are the first
        ones. ``breaks[t, b]``: a line end lies between t - 1 and t. ``start`` and ``end`` (B, K)
        are the messages from what lies before and after a sequence.
        """
        t, b, k = emission.shape
        e = np.exp(emission - emission.max(axis=2, keepdims=True))
        a_in, a_out = np.exp(within).astype(e.dtype), np.exp(across).astype(e.dtype)
        alive = np.searchsorted(-sizes, -np.arange(t), side="left")
        cuts = [np.flatnonzero(breaks[i, : alive[i]]) for i in range(t)]
        alpha = np.zeros_like(e)
        first = e[0] if start is None else e[0] * start
        alpha[0] = first / first.sum(1, keepdims=True)
        for i in range(1, t):
            m, cut = alive[i], cuts[i]
            x = alpha[i - 1, :m]
            y = x @ a_in
            if len(cut):
                y[cut] = x[cut] @ a_out
            y *= e[i, :m]
            y /= y.sum(1, keepdims=True)
            alpha[i, :m] = y
        beta = np.ones((b, k), e.dtype) if end is None else end.astype(e.dtype)
        exp_in, exp_out = np.zeros((k, k)), np.zeros((k, k))
        for i in range(t - 1, -1, -1):
            m, cut = alive[i], cuts[i]
            post = alpha[i, :m]
            back = beta[:m]
            if i:
                eb = e[i, :m] * back
                if pairs:
                    keep = np.ones(m, bool)
                    keep[cut] = False
                    for rows, trans, acc in ((keep, a_in, exp_in), (~keep, a_out, exp_out)):
                        p, q = alpha[i - 1, :m][rows], eb[rows]
                        norm = np.einsum("bi,ij,bj->b", p, trans, q)
                        acc += trans * np.einsum("bi,bj->ij", p / norm[:, None], q)
                before = eb @ a_in.T
                if len(cut):
                    before[cut] = eb[cut] @ a_out.T
                before /= before.sum(1, keepdims=True)
            post *= back
            post /= post.sum(1, keepdims=True)
            if i:
                beta[:m] = before
        return alpha, exp_in, exp_out

    @staticmethod
    def _transfers(emission: np.ndarray, breaks: np.ndarray, sizes: np.ndarray, within: np.ndarray, across: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """(B, K, K): what a sequence makes of the message before it, up to a factor; ``entry`` (B, K, K) leads into its first word."""
        t, b, k = emission.shape
        e = np.exp(emission - emission.max(axis=2, keepdims=True))
        a_in, a_out = np.exp(within).astype(e.dtype), np.exp(across).astype(e.dtype)
        alive = np.searchsorted(-sizes, -np.arange(t), side="left")
        x = entry.astype(e.dtype) * e[0][:, None, :]
        for i in range(1, t):
            m = alive[i]
            y = x[:m] @ a_in
            cut = np.flatnonzero(breaks[i, :m])
            if len(cut):
                y[cut] = x[cut] @ a_out
            y *= e[i, :m][:, None, :]
            y /= y.sum((1, 2), keepdims=True)
            x[:m] = y
        return x

    def messages(self, emission: np.ndarray, breaks: np.ndarray, sizes: np.ndarray, place: np.ndarray, level: np.ndarray, cut_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of blocks that follow one another in texts.

        ``place``: column of every block in the emissions; ``level``: its number within the text;
        ``cut_before``: a line end lies before it. Blocks of one text stand side by side.
        """
        n = len(level)
        start, end = np.ones((n, K)), np.ones((n, K))
        many = (level > 0) | np.r_[level[1:] > 0, False]
        if not many.any():
            return start, end
        entry = np.where(cut_before[:, None, None], np.exp(self.across), np.exp(self.within))
        entry[level == 0] = np.eye(K)
        own = np.flatnonzero(many)
        own = own[np.argsort(place[own])]
        over = np.zeros((n, K, K))
        over[own] = self._transfers(emission[:, place[own]], breaks[:, place[own]], sizes[place[own]], self.within, self.across, entry[own])
        left = np.ones((n, K))
        for k in range(level.max() + 1):
            at = np.flatnonzero(many & (level == k))
            if k:
                start[at] = np.einsum("bi,bij->bj", left[at - 1], entry[at])
            left[at] = np.einsum("bi,bij->bj", left[at - 1], over[at]) if k else over[at].sum(1)
            left[at] /= left[at].sum(1, keepdims=True)
        for k in range(level.max(), 0, -1):
            at = np.flatnonzero(level == k)
            end[at - 1] = np.einsum("bij,bj->bi", over[at], end[at])
            end[at - 1] /= end[at - 1].sum(1, keepdims=True)
        return start, end

    # -- training ----------------------------------------------------------------------------
    @classmethod
    def fit(cls, sequences: list[list[tuple[str, int, bool]]], bound: TrainingBound) -> Crf:
        """Full-batch maximum likelihood with per-weight step sizes. A sequence: (word, label, line end before)."""
        vocabulary: dict[str, int] = {}
        features: dict[str, int] = {}
        rows: list[list[int]] = []
        sequences = sorted((s for s in sequences if s), key=len, reverse=True) or [[("", 0, False)]]
        for s in sequences:
            for w, _, _ in s:
                if w not in vocabulary:
                    vocabulary[w] = len(vocabulary)
                    rows.append([features.setdefault(f, len(features)) for f in word_features(w)])
        flat = np.concatenate([np.array(r, dtype=np.int64) for r in rows])
        starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        t = max(map(len, sequences))
        b = len(sequences)
        index, label = np.zeros((t, b), np.int64), np.zeros((t, b), np.int64)
        breaks, sizes = np.zeros((t, b), bool), np.array([len(s) for s in sequences])
        for i, s in enumerate(sequences):
            index[: len(s), i] = [vocabulary[w] for w, _, _ in s]
            label[: len(s), i] = [y for _, y, _ in s]
            breaks[: len(s), i] = [z for _, _, z in s]
        alive = np.arange(t)[:, None] < sizes[None, :]
        n_words, n = len(rows), int(alive.sum())
        seen = np.zeros((n_words, K))
        np.add.at(seen, (index[alive], label[alive]), 1.0)
        got_in, got_out = np.zeros((K, K)), np.zeros((K, K))
        step = alive[1:]
        for mask, acc in ((step & ~breaks[1:], got_in), (step & breaks[1:], got_out)):
            np.add.at(acc, (label[:-1][mask], label[1:][mask]), 1.0)
        weights = np.zeros((len(features), K))
        within, across = np.zeros((K, K)), np.zeros((K, K))
        sq = [np.full_like(x, 1e-8) for x in (weights, within, across)]
        for it in range(bound.iterations):
            scores = np.add.reduceat(weights[flat], starts, axis=0)
            post, exp_in, exp_out = cls._run(scores[index].astype(np.float32), breaks, sizes, within, across, True)
            expected = np.stack([np.bincount(index[alive], weights=post[:, :, j][alive], minlength=n_words) for j in range(K)], axis=1)
            diff = (seen - expected) / n
            grad = np.stack([np.bincount(flat, weights=diff[owner, j], minlength=len(features)) for j in range(K)], axis=1)
            rate = 0.5 / (1 + it / 20)
            for x, g, s in ((weights, grad - bound.l2 * weights / n, sq[0]), (within, (got_in - exp_in) / n, sq[1]), (across, (got_out - exp_out) / n, sq[2])):
                s *= 0.9
                s += 0.1 * g * g
                x += rate * 0.2 * g / (np.sqrt(s) + 1e-6)
        return cls(features, weights.astype(np.float32), within, across)

    # -- inference ---------------------------------------------------------------------------
    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of words; features the training never saw count nothing."""
        get, none = self.features.get, len(self.features)
        rows = [[i for f in word_features(w) if (i := get(f)) is not None] or [none] for w in words]
        starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
        padded = np.concatenate([self.weights, np.zeros((1, K), self.weights.dtype)]) if none in map(_first, rows) else self.weights
        return np.add.reduceat(padded[np.concatenate(rows)], starts, axis=0)


def _first(row: list[int]) -> int:
    return row[0]


class Labeller:
    """Labels documents in batches; keeps a memo of word scores. Entry 0 of the memo is the line end."""

    def __init__(self, model: Crf):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {"\n": 0}
        self.table = np.zeros((4096, K), np.float32)

    def _learn(self, texts: list[list[str]]) -> None:
        """Score the words that the memo lacks."""
        memo = self.memo
        if len(memo) > MEMO:
            self._clear()
            memo = self.memo
        fresh = list({w for pieces in texts for w in pieces if w not in memo})
        if fresh:
            while len(memo) + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(memo) : len(memo) + len(fresh)] = self.model.scores(fresh)
            memo.update(zip(fresh, range(len(memo), len(memo) + len(fresh))))

    def line_sums(self, texts: list[str]) -> list[np.ndarray]:
        """For each cleaned text the summed marginals per line, (lines, K)."""
        found = [_PIECE.findall(text) for text in texts]
        self._learn(found)
        words: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        sizes: list[int] = []
        level: list[int] = []
        bounds = [0]
        for text, pieces in zip(texts, found):
            flat = np.array(list(map(self.memo.__getitem__, pieces)), np.int64)
            ends = flat == 0
            line = np.cumsum(ends)[~ends]
            flat = flat[~ends]
            first = bounds[-1]
            bounds.append(first + text.count("\n") + 1)
            if not len(flat):
                continue
            words.append(flat)
            owners.append(line + first)
            # greedy blocks of whole lines; a line longer than a block goes on in the next
            start, n, before = 0, len(flat), len(sizes)
            while n - start > BLOCK_WORDS:
                cut = start + BLOCK_WORDS
                back = int(np.searchsorted(line, line[cut]))
                cut = back if back > start else cut
                sizes.append(cut - start)
                start = cut
            sizes.append(n - start)
            level += range(len(sizes) - before)
        sums = np.zeros((bounds[-1], K))
        if words:
            flat, owner = np.concatenate(words), np.concatenate(owners)
            length = np.array(sizes)
            firsts = np.cumsum(length) - length
            order = np.argsort(-length, kind="stable")
            column = np.empty_like(order)
            column[order] = np.arange(len(order))
            at_b = np.repeat(column, length)
            at_t = np.arange(len(flat)) - np.repeat(firsts, length)
            new = np.r_[True, owner[1:] != owner[:-1]]
            shape = (int(length.max()), len(order))
            index, breaks = np.zeros(shape, np.int64), np.zeros(shape, bool)
            index[at_t, at_b] = flat
            breaks[at_t, at_b] = new
            breaks[0] = False
            emission = self.table[index]
            start, end = self.model.messages(emission, breaks, length[order], column, np.array(level), new[firsts])
            post, _, _ = Crf._run(emission, breaks, length[order], self.model.within, self.model.across, False, start[order], end[order])
            starts = np.flatnonzero(new)
            sums[owner[starts]] = np.add.reduceat(post[at_t, at_b], starts, axis=0)
        return [sums[a:b] for a, b in zip(bounds, bounds[1:])]


_BUILT: dict[str, Labeller] = {}


def _labeller(name: str, shared: Broadcast) -> Labeller:
    """The labeller of a model, kept with its memo by a worker for its further tasks."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Labeller(Crf(*shared.value))
    return _BUILT[name]


def training_sequences(rows: list[tuple[str, str]], bound: TrainingBound) -> list[list[tuple[str, int, bool]]]:
    """Blocks of labelled words of (text, declared code) rows; clear lexicon votes overrule a line's label."""
    out: list[list[tuple[str, int, bool]]] = []
    size = 64
    for text, code in rows:
        if L.text_class(text[:20000]) != "prosa":
            continue
        declared = LANGUAGES.index(code)
        whole = lexicon_language([w.lower() for w in _WORD.findall(text[:8000])], 4)
        if whole is not None:
            declared = whole
        block: list[tuple[str, int, bool]] = []
        left = bound.words
        for line in L.clean(text).split("\n"):
            words = _WORD.findall(line)[:left]
            if not words:
                continue
            own = lexicon_language([w.lower() for w in words], 3)
            y = declared if own is None else own
            for i, w in enumerate(words):
                block.append((w, y, i == 0 and bool(block)))
                if len(block) == size:
                    out.append(block)
                    block = []
            left -= len(words)
            if left <= 0:
                break
        if block:
            out.append(block)
    return out


def training_rows(labelled: DataFrame, bound: TrainingBound) -> list[tuple[str, str]]:
    """Bounded sample of ``clave, texto, codigo`` rows: about the ``rows`` smallest hashes of every language.

    The labels are counted first; the texts are then read once, and only rows whose hash
    lies under OVERSAMPLE times the share wanted of their language leave the executors.
    """
    known = labelled.where(F.col("codigo").isNotNull())
    sizes = {r.codigo: r.n for r in known.groupBy("codigo").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    steps = 1_000_000
    place = F.pmod(F.xxhash64("clave", "codigo"), F.lit(steps))
    chance = F.lit(0)
    for code, n in sizes.items():
        chance = F.when(F.col("codigo") == code, min(steps, OVERSAMPLE * bound.rows * steps // n + 1)).otherwise(chance)
    sample = known.where(place < chance).select("clave", "codigo", place.alias("lugar"), F.substring("texto", 1, 40 * bound.words).alias("texto")).where(F.length("texto") > LEAST_SAMPLE_CHARS).collect()
    out: list[tuple[str, str]] = []
    for code in sorted(sizes):
        own = sorted((r for r in sample if r.codigo == code), key=lambda r: (r.lugar, r.clave))
        out += [(r.texto, code) for r in own[: bound.rows]]
    return out


def fit_model(labelled: list[DataFrame], bound: TrainingBound = TrainingBound()) -> Crf:
    """Fit the chain on the bounded samples of tables of ``clave, texto, codigo``."""
    rows = [r for df in labelled for r in training_rows(df, bound)]
    return Crf.fit(training_sequences(rows, bound), bound)


def save_model(spark: SparkSession, model: Crf, path: str) -> None:
    """Write a fitted chain as one Parquet table of features and transitions, for ``load_model``."""
    rows = [(f, [float(x) for x in model.weights[i]]) for f, i in model.features.items()]
    rows += [(f"{name}>{i}", [float(x) for x in row]) for name, table in (("within", model.within), ("across", model.across)) for i, row in enumerate(table)]
    spark.createDataFrame(rows, "rasgo string, pesos array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Crf:
    """The chain of ``save_model``; its size is that of the bounded training sample's features."""
    rows = {r.rasgo: r.pesos for r in spark.read.parquet(path).collect()}
    within, across = (np.array([rows.pop(f"{name}>{i}") for i in range(K)]) for name in ("within", "across"))
    return Crf({f: i for i, f in enumerate(rows)}, np.array(list(rows.values()), np.float32).reshape(-1, K), within, across)


_SEGMENT = "struct<linea:int,n_caracteres:int,n_palabras:int,idioma:string,confianza:double>"


def label_texts(df: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "texto", extra: tuple[str, ...] = (), declared_col: str | None = None, every: bool = True) -> DataFrame:
    """``id_col, extra…, idioma, confianza, clase, mixto, segmentos`` per row.

    ``segmentos`` holds every sizable line with words of a language. Without ``every``
    they are given for mixed texts only, and ``clase`` is left null where the text is
    not mixed and the code in ``declared_col`` is right. Null and
    empty texts, and texts without words, get a null language and no segments;
    spam, tables and damaged text are labelled too, and ``clase`` names them.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.features, model.weights, model.within, model.across))
    rows = df.select(F.col(id_col).alias("id_"), *extra, F.col(text_col).alias("texto_"))
    kinds = dict(rows.dtypes)

    name = uuid.uuid4().hex

    def make():
        labeller = _labeller(name, shared)

        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c: cols[c] for c in ("id_", *extra)}
            out |= {"idioma": [], "confianza": [], "clase": [], "mixto": []}
            sizes: list[int] = []
            number: list[int] = []
            chars: list[int] = []
            count: list[int] = []
            which: list[str] = []
            sure: list[float] = []
            texts = [L.clean(t) if t else "" for t in cols["texto_"]]
            declared = cols[declared_col] if declared_col else [None] * len(texts)
            for raw, text, code, sums in zip(cols["texto_"], texts, declared, labeller.line_sums(texts)):
                lines = text.split("\n")
                before, mixed, best = len(number), False, -1
                total = sums.sum(axis=0)
                weight = float(total.sum())
                if weight:
                    best = int(total.argmax())
                    tops = sums.argmax(axis=1).tolist()
                    # sizes are those of the text as it is stored; cleaning keeps the number of lines
                    long = [i for i, x in enumerate(raw.split("\n")) if len(x) >= LINE_CHARS and len(x.strip()) >= LINE_CHARS]
                    if every or any(tops[i] != best for i in long):
                        for i in long:
                            x, j = lines[i], tops[i]
                            ws = _WORD.findall(_ADDRESS.sub(" ", x) if "://" in x else x)
                            if len(ws) < CAPITAL_WORDS if x.isupper() else sum(map(str.islower, ws)) < LINE_WORDS:
                                continue
                            if j != best and L.line_kind(x) in ("basura", "tabla"):
                                continue
                            mixed |= j != best
                            number.append(i + 1)
                            chars.append(len(x.strip()))
                            count.append(len(ws))
                            which.append(LANGUAGES[j])
                            sure.append(float(sums[i, j] / sums[i].sum()))
                        if not mixed and not every:
                            for column in (number, chars, count, which, sure):
                                del column[before:]
                sizes.append(len(number) - before)
                language = LANGUAGES[best] if weight else None
                out["idioma"].append(language)
                out["confianza"].append(float(total[best]) / weight if weight else None)
                out["clase"].append(L.lines_class(lines) if every or mixed or code is None or code != language else None)
                out["mixto"].append(mixed)
            return out | {"segmentos": nested(sizes, linea=(number, pa.int32()), n_caracteres=(chars, pa.int32()), n_palabras=(count, pa.int32()), idioma=(which, pa.string()), confianza=(sure, pa.float64()))}

        return run

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("id_", *extra)) + f", idioma string, confianza double, clase string, mixto boolean, segmentos array<{_SEGMENT}>"
    return map_rows(rows, make, schema).withColumnRenamed("id_", id_col)


def labels_in_force(etiquetas: DataFrame) -> DataFrame:
    """``doc_id, declarado`` by the latest registration (of equal ones the largest label)."""
    latest = etiquetas.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.struct("registrado_en", "idioma")).alias("m"))
    return latest.select("doc_id", F.col("m.idioma").alias("declarado"))


def p1_labelled(coleccion: DataFrame, etiquetas: DataFrame, documents: DataFrame, bound: TrainingBound = TrainingBound(), every: bool = True, model: Crf | None = None) -> DataFrame:
    """Both tables labelled: ``tabla, doc_id, declarado, idioma, confianza, clase, mixto, segmentos``. Without a ``model`` one is fitted."""
    declared = labels_in_force(etiquetas).withColumn("declarado", declared_language(F.col("declarado")))
    theirs = documents.select("doc_id", F.col("text").alias("texto"), declared_language(F.col("lang")).alias("declarado"))
    sample = theirs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("clave"), "texto", F.col("declarado").alias("codigo"))
    coleccion = coleccion.select("doc_id", "texto")
    pages = coleccion.join(declared, "doc_id").select(F.concat(F.lit("c"), F.col("doc_id")).alias("clave"), "texto", F.col("declarado").alias("codigo"))
    model = model or fit_model([sample, pages], bound)
    a = label_texts(coleccion, model, every=every).join(declared, "doc_id", "left").withColumn("tabla", F.lit("coleccion"))
    b = label_texts(theirs, model, extra=("declarado",), declared_col="declarado", every=every).withColumn("tabla", F.lit("documents"))
    return a.unionByName(b)


def p1_found(coleccion: DataFrame, etiquetas: DataFrame, documents: DataFrame, bound: TrainingBound = TrainingBound()) -> DataFrame:
    """``tabla, doc_id, linea, idioma``: wrong or missing labels (linea 0) and the lines of mixed texts."""
    texts = p1_labelled(coleccion, etiquetas, documents, bound, every=False).where(F.col("idioma").isNotNull() & F.col("clase").isin("prosa", "lista"))
    wrong = F.when(F.col("declarado").isNull() | (F.col("declarado") != F.col("idioma")), F.array(F.struct(F.lit(0).alias("linea"), F.col("idioma").alias("idioma")))).otherwise(F.array().cast("array<struct<linea:int,idioma:string>>"))
    lines = F.when(F.col("mixto"), F.transform("segmentos", lambda s: F.struct(s["linea"].alias("linea"), s["idioma"].alias("idioma")))).otherwise(F.array().cast("array<struct<linea:int,idioma:string>>"))
    return texts.select("tabla", "doc_id", F.explode(F.concat(wrong, lines)).alias("c")).select("tabla", "doc_id", "c.linea", "c.idioma")
