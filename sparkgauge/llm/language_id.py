"""Language identification by a linear-chain conditional random field over words.

Each word has hashed features: its beginnings and endings, its character trigrams, and itself (the lexicon); transitions
between labels are learned, from runs of words of different documents put together, so that switching inside a text is
learned too. Forward-backward gives each word's label probabilities; a document's language is the label with the largest
share of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textvec

UNKNOWN = "und"
#: Rows of the feature table; training documents and those of a language, at most; words of a run, of which a text has any number.
FEATURES, TRAIN_ROWS, ALIKE, RUN = 1 << 16, 6_000, 1_000, 32
#: Runs joined to a training sequence; sequences of a step; steps at least; learning rate.
JOINED, BATCH, STEPS, RATE, SEED = 3, 64, 240, 0.08, 5
REMEMBERED = 250_000
SLICE = 2 << 20


def letters(token: str) -> str:
    """A token's letters in lower case."""
    return token.lower() if token.isalpha() else "".join(c for c in token.lower() if c.isalpha())


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of words of at least one letter, for all of them at once.

    (trigrams, word after word; the words' lengths, which are the numbers of their trigrams; (words, 7): the beginnings
    and endings of one to three letters and the whole word, FEATURES where a word is too short).
    """
    n = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer(("_" + "__".join(words) + "_").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(n + 2) - (n + 2)
    k = np.uint64(0x1F123BB5)
    row = lambda h, kind: (textvec.mix(h * np.uint64(16) + np.uint64(kind)) & np.uint64(FEATURES - 1)).astype(np.int64)
    at = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
    trigrams = row((code[at] * k + code[at + 1]) * k + code[at + 2], 0)
    parts = np.full((len(words), 7), FEATURES, np.int64)
    head = tail = np.zeros(len(words), np.uint64)
    for size in (1, 2, 3):
        long = n >= size
        head = head * k + code[np.minimum(start + size, len(code) - 1)]
        tail = tail * k + code[np.maximum(start + n + 1 - size, 0)]
        parts[long, 2 * size - 2] = row(head, 2 * size - 1)[long]
        parts[long, 2 * size - 1] = row(tail, 2 * size)[long]
    up, down = textvec.powers(len(code) + 1)
    total = np.append(np.uint64(0), np.cumsum(code * up[:-1]))
    parts[:, 6] = row((total[start + n + 1] - total[start + 1]) * down[start + 1], 7)
    return trigrams, n, parts


@dataclass
class Model:
    """Labels, feature weights (FEATURES, labels) and transition scores (labels, labels): fixed in size."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, labels): the mean weights, by the root of their number, of each word's features."""
        trigrams, n, parts = word_features(words)
        w = np.concatenate([self.weights, np.zeros((1, len(self.labels)))])
        total = np.add.reduceat(w[trigrams], np.cumsum(n) - n) + w[parts].sum(1)
        return total / np.sqrt(n + (parts < FEATURES).sum(1))[:, None]


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Label probabilities of every word, for many sequences side by side.

    ``emissions`` (words, labels) are log scores, sequence after sequence, of ``lengths`` words each. All sequences take
    a step together, the longest first, so work is in proportion to the words, however uneven the lengths are. With
    ``pairs``, the expected number of each transition is returned too.
    """
    n_words, k = emissions.shape
    expected = np.zeros((k, k))
    if not n_words:
        return (np.zeros((0, k)), expected) if pairs else np.zeros((0, k))
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    active = np.searchsorted(np.sort(lengths), np.arange(lengths.max()), "right")
    active = len(lengths) - active
    first = np.cumsum(active) - active
    within = np.arange(n_words) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = first[within] + np.repeat(rank, lengths)
    e = np.empty((n_words, k), np.float64)
    e[at] = np.exp(emissions - emissions.max(1, keepdims=True))
    a = np.exp(transitions - transitions.max())
    alpha = np.empty_like(e)
    before = None
    for f, n in zip(first.tolist(), active.tolist(), strict=True):
        x = e[f : f + n] if before is None else (before[:n] @ a) * e[f : f + n]
        x = x / x.sum(1, keepdims=True)
        alpha[f : f + n] = before = x
    beta = np.ones((len(lengths), k))
    up = a.T.copy()
    for t in range(len(active) - 2, -1, -1):
        f, n = first[t + 1], active[t + 1]
        ahead = beta[:n] * e[f : f + n]
        x = ahead @ up
        if pairs:
            g = first[t]
            mass = (alpha[g : g + n] * x).sum(1, keepdims=True)
            expected += a * (alpha[g : g + n].T @ (ahead / mass))
        beta[:n] = x / x.sum(1, keepdims=True)
        f, n = first[t], active[t]
        alpha[f : f + n] *= beta[:n]
    alpha /= alpha.sum(1, keepdims=True)
    return (alpha[at], expected) if pairs else alpha[at]


class Known:
    """Rows of a growing table of emissions, by word and by token; row 0 is for tokens without letters."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.tokens: dict[str, int] = {}
        self.words: dict[str, int] = {"": 0}
        self.table = np.zeros((1, len(self.model.labels)))

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """The rows of each text's tokens; what is new is added first, all at once."""
        if len(self.tokens) > REMEMBERED:
            self.clear()
        each = [t.split() for t in texts]
        new = set()
        for tokens in each:
            new.update(tokens)
        new.difference_update(self.tokens)
        added: list[str] = []
        for token in new:
            word = letters(token)
            row = self.words.get(word)
            if row is None:
                row = self.words[word] = len(self.table) + len(added)
                added.append(word)
            self.tokens[token] = row
        if added:
            self.table = np.concatenate([self.table, self.model.emissions(added)])
        look = self.tokens.__getitem__
        return [np.fromiter(map(look, tokens), np.int64, len(tokens)) for tokens in each]


def predict(model: Model, known: Known, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; UNKNOWN and 0 for one without letters."""
    rows = known.rows(texts)
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    share = np.zeros((len(texts), len(model.labels)))
    if len(flat) and len(model.labels):
        p = forward_backward(known.table[flat], lengths, model.transitions) * (flat > 0)[:, None]
        there = np.flatnonzero(lengths)
        share[there] = np.add.reduceat(p, (np.cumsum(lengths) - lengths)[there])
    total = share.sum(1)
    best = share.argmax(1) if len(model.labels) else np.zeros(len(texts), int)
    names = [model.labels[b] if t > 0 else UNKNOWN for b, t in zip(best, total, strict=True)]
    return names, np.where(total > 0, share.max(1, initial=0.0) / np.maximum(total, 1e-300), 0.0)


def spans(model: Model, known: Known, text: str) -> list[tuple[int, int, str, float]]:
    """(start, length, label, mean probability) of each stretch of words of one likeliest label, in characters of the text.

    Words without letters go with the stretch before them; those before the first word with a letter are in none.
    """
    rows = known.rows([text])[0]
    if not len(rows) or not len(model.labels):
        return []
    p = forward_backward(known.table[rows], np.array([len(rows)], np.int64), model.transitions)
    found: list[list] = []
    for word, row, share in zip(re.finditer(r"\S+", text), rows, p, strict=True):
        label = model.labels[share.argmax()]
        if row and (not found or found[-1][2] != label):
            found.append([word.start(), word.end(), label, 0.0, 0])
        if found:
            found[-1][1] = word.end()
            if row:
                found[-1][3] += share.max()
                found[-1][4] += 1
    return [(a, b - a, label, float(total / n)) for a, b, label, total, n in found]


def _spanned(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.value
        known = Known(value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("label", pa.string()), ("probability", pa.float64())]))
        for batch in batches:
            at = batch.schema.names.index("_text")
            others = [i for i in range(batch.num_columns) if i != at]
            for a, b, _, _ in textvec.slices(batch.column(at), SLICE):
                texts = textvec.strings(batch.column(at).slice(a, b - a))
                made = [[dict(zip(("start", "length", "label", "probability"), x, strict=True)) for x in spans(value, known, t or "")] for t in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in others), pa.array(made, kind)], names=[*(batch.schema.names[i] for i in others), "spans"])

    return run


def label_spans(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and spans: the stretches of one language in each text, with their place, label and probability.

    Null texts and texts without letters have none. Places count characters (code points) from 0.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))
    fields = "array<struct<start:bigint,length:bigint,label:string,probability:double>>"
    return rows.mapInArrow(common.lean(_spanned(docs.sparkSession.sparkContext.broadcast(model))), common.schema(rows, "_text", f"spans {fields}"))


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.value
        known = Known(value)
        for batch in batches:
            at = batch.schema.names.index("_text")
            others = [i for i in range(batch.num_columns) if i != at]
            for a, b, _, _ in textvec.slices(batch.column(at), SLICE):
                texts = textvec.strings(batch.column(at).slice(a, b - a))
                names, scores = predict(value, known, texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in others), pa.array(names, pa.string()), pa.array(scores)], names=[*(batch.schema.names[i] for i in others), "lang_pred", "score"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of RUN words of each text."""
    for batch in batches:
        langs, ids, runs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for i, text in enumerate(textvec.strings(batch.column(2))):
            words = (text or "").split()
            runs.extend((langs[i], ids[i], place, " ".join(words[place * RUN : (place + 1) * RUN])) for place in range(-(-len(words) // RUN)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in runs], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["lang", "id", "place", "words"])


def fit(runs: list[tuple[str, str]]) -> Model:
    """Weights and transitions by stochastic gradient ascent (Adagrad) on the likelihood of joined runs of words.

    ``runs``: (language, words with spaces between). Each language's runs are dealt in a seeded order, over and over,
    for STEPS steps or until every run of every language has been learned from, whichever is more. Without any, the
    model has no labels and predicts UNKNOWN.
    """
    labels = sorted({lang for lang, _ in runs})
    k = len(labels)
    number = {lang: i for i, lang in enumerate(labels)}
    model = Model(labels, np.zeros((FEATURES, k)), np.zeros((k, k)))
    if k < 2:
        return model
    codes: dict[str, int] = {}
    by = [[] for _ in labels]
    for lang, words in runs:
        found = np.array([codes.setdefault(w, len(codes)) for w in map(letters, words.split()) if w], np.int32)
        if len(found):
            by[number[lang]].append(found)
    if not codes:
        return model
    trigrams, n, parts = word_features(list(codes))
    ends = np.cumsum(n)
    memo = [np.concatenate([trigrams[e - m : e], q[q < FEATURES]]) for e, m, q in zip(ends, n, parts, strict=True)]
    random = np.random.default_rng(SEED)
    there = [i for i in range(k) if by[i]]
    order = [random.permutation(len(b)) for b in by]
    dealt = [0] * k

    def deal() -> tuple[int, np.ndarray]:
        # languages are drawn alike, however many texts each has
        i = there[random.integers(len(there))]
        at = order[i][dealt[i] % len(by[i])]
        dealt[i] += 1
        return i, by[i][at]

    g_w, g_t = np.full((FEATURES, k), 1e-4), np.full((k, k), 1e-2)
    step = 0
    while step < STEPS or any(dealt[i] < len(by[i]) for i in there):
        step += 1
        picks = [[deal() for _ in range(JOINED)] for _ in range(BATCH)]
        words = [(y, memo[w]) for sequence in picks for y, found in sequence for w in found]
        lengths = np.array([sum(len(found) for _, found in sequence) for sequence in picks], np.int64)
        y = np.array([w[0] for w in words])
        sizes = np.array([len(f) for _, f in words])
        flat = np.concatenate([f for _, f in words])
        scale = 1 / np.sqrt(sizes)
        emissions = np.add.reduceat(model.weights[flat], np.cumsum(sizes) - sizes) * scale[:, None]
        p, pairs = forward_backward(emissions, lengths, model.transitions, pairs=True)
        error = -p
        error[np.arange(len(y)), y] += 1
        spread = np.repeat(error * scale[:, None], sizes, 0)
        grad = np.stack([np.bincount(flat, spread[:, j], FEATURES) for j in range(k)], 1) / BATCH
        inner = np.ones(len(y), bool)
        inner[np.cumsum(lengths) - lengths] = False
        here = np.flatnonzero(inner)
        trans = np.zeros((k, k))
        np.add.at(trans, (y[here - 1], y[here]), 1)
        trans = (trans - pairs) / BATCH
        g_w += grad * grad
        g_t += trans * trans
        model.weights += RATE * grad / np.sqrt(g_w)
        model.transitions += RATE * trans / np.sqrt(g_t)
    return model


def train(docs: DataFrame, label: str = "lang", modulus: int = 3, held_out: int = 1, rows: int = TRAIN_ROWS, text: str = "text") -> Model:
    """The model from at most ``rows`` documents with a text and a label outside the held-out share.

    Languages share ``rows`` evenly (at least one document and at most ALIKE each, in a seeded order), so that a rare one
    is learned as well as a common one; more languages than ``rows`` are an error. Whole texts are learned from; of rows
    that share a doc_id and label one text, the smallest. doc_id may have any type.
    """
    known = docs.select(F.col("doc_id").cast("string").alias("_id"), F.col(label).alias("_lang"), F.col(text).alias("_text"), common.crc_mod("doc_id", modulus).alias("_part"))
    known = known.where(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (F.col("_part") != held_out)).drop("_part")
    labels = known.select("_lang").distinct().limit(rows + 1).count()
    if labels > rows:
        raise ValueError(f"more than {rows} languages")
    each = Window.partitionBy("_lang").orderBy("_hash", "_id")
    ids = known.select("_lang", "_id", F.xxhash64("_id", F.lit(17)).alias("_hash")).distinct()
    # Spark limits each task's rows of a language before it shuffles them, so a common language isn't gathered
    chosen = ids.withColumn("_rank", F.row_number().over(each)).where(F.col("_rank") <= max(1, min(ALIKE, rows // max(labels, 1)))).select("_lang", "_id")
    texts = known.join(F.broadcast(chosen), ["_lang", "_id"]).groupBy("_lang", "_id").agg(F.min("_text").alias("_text"))
    runs = texts.select("_lang", F.xxhash64("_id").alias("id"), "_text").mapInArrow(common.lean(_runs), "lang string, id long, place long, words string").collect()
    return fit([(r["lang"], r["words"]) for r in sorted(runs, key=lambda r: (r["id"], r["place"], r["lang"], r["words"]))])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score (the language's share of the words, 0 to 1) of every row of ``docs``.

    Null texts and texts without letters are ``und`` with score 0. Ties go to the label that sorts first. Repeated rows
    come back as often as they are there; only ``keep`` and the text are read.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(common.lean(_predicted(docs.sparkSession.sparkContext.broadcast(model))), common.schema(rows, "_text", "lang_pred string, score double"))
