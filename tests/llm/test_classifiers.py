import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.llm import common, language_id, quality_classifier, textvec, toxicity
from tests.llm.helpers import SCHEMA, awkward, frame

LABELS = "doc_id long, quality int, toxic int"


def test_runs_and_hashes():
    texts = ["ab  cd", "", "cd", " \n", "é€x ab"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts, ends, doc = textvec.runs(data, offsets, textvec.WORDS)
    assert [(bytes(data[a:b]).decode(), d) for a, b, d in zip(starts, ends, doc, strict=True)] == [("ab", 0), ("cd", 0), ("cd", 2), ("é€x", 4), ("ab", 4)]
    h = textvec.hashes(data, starts, ends).tolist()
    assert h[0] == h[4] and h[1] == h[2] and len(set(h)) == 3


def test_slices_cover_every_row():
    import pyarrow as pa

    texts = [None, "abc", "", "d" * 50, None, "e"]
    for limit in (1, 4, 1000):
        got = [bytes(d[o[i] : o[i + 1]]).decode() for _, _, d, o in textvec.slices(pa.array(texts), limit) for i in range(len(o) - 1)]
        assert got == [t or "" for t in texts]
        assert [bytes(d[o[i] : o[i + 1]]).decode() for _, _, d, o in textvec.slices(pa.array(texts).slice(1, 3), limit) for i in range(len(o) - 1)] == ["abc", "", "d" * 50]


# --- language ------------------------------------------------------------------------------------------------------


def test_forward_backward_against_all_paths():
    random.seed(0)
    rng = np.random.default_rng(0)
    lengths, k = np.array([3, 0, 1, 5]), 3
    e, t = rng.normal(size=(9, k)), rng.normal(size=(k, k))
    got, pairs = language_id.forward_backward(e, lengths, t, pairs=True)
    at, expected = 0, np.zeros((k, k))
    for n in lengths:
        total, marginal = 0.0, np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.exp(sum(e[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for i, y in enumerate(path):
                marginal[i, y] += w
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.exp(sum(e[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
            for a, b in zip(path, path[1:], strict=False):
                expected[a, b] += w / total
        assert np.allclose(got[at : at + n], marginal / max(total, 1e-300))
        at += n
    assert np.allclose(pairs, expected)


def test_word_features_are_the_same_alone_and_together():
    every = ["a", "ab", "straße", "ñu", "x" * 90]
    tri, n, parts = language_id.word_features(every)
    at = 0
    for i, w in enumerate(every):
        t, m, p = language_id.word_features([w])
        assert t.tolist() == tri[at : at + n[i]].tolist() and p.tolist() == parts[i : i + 1].tolist() and m[0] == len(w) == n[i]
        at += n[i]
    assert language_id.letters("It's 4U,") == "itsu"


def speech(lang, n, seed):
    r = random.Random(seed)
    parts = {"aa": ["ka", "to", "mi", "su"], "bb": ["sch", "ung", "ein", "zu"], "cc": ["eau", "oux", "ère", "qu"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_languages_and_switching(spark):
    rows = [(i, speech(x := "aa bb cc".split()[i % 3], 40, i), x, "s", 1) for i in range(240)]
    model = language_id.train(spark.createDataFrame(rows, SCHEMA))
    assert model.labels == ["aa", "bb", "cc"] and np.diag(model.transitions).mean() > model.transitions[~np.eye(3, dtype=bool)].mean()
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, SCHEMA), model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.97 * len(held)
    mixed = speech("aa", 30, 1) + " " + speech("cc", 20, 2)
    known = language_id.Known(model)
    e = known.rows([mixed])[0]
    p = language_id.forward_backward(known.table[e], np.array([50]), model.transitions).argmax(1)
    assert (p[:30] == 0).mean() > 0.9 and (p[30:] == 2).mean() > 0.9


def test_text_ids_repeated_rows_and_a_rare_language(spark):
    rows = [(f"id-{i}", speech(x := "aa" if i % 60 else "cc", 40, i), x) for i in range(600)]
    docs = spark.createDataFrame([*rows, *rows[:1] * 50, *rows[60:61] * 50], "doc_id string, text string, lang string")
    model = language_id.train(docs, rows=40)
    assert model.labels == ["aa", "cc"] and language_id.train(docs.dropDuplicates(), rows=40).weights.tolist() == model.weights.tolist()
    got = language_id.identify(docs, model).dropDuplicates().collect()
    assert len(got) == 600 and sum(r["lang_pred"] == dict((i, x) for i, _, x in rows)[r["doc_id"]] for r in got) > 580
    with pytest.raises(ValueError):
        language_id.train(docs, rows=1)


def test_one_text_of_each_id_is_learned_from(spark):
    docs = spark.createDataFrame([(1, "b", "", "", 1), (1, "a", "", "", 1), (2, None, "", "", 1)] * 9, SCHEMA)
    sample = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, label int")
    assert sorted(map(tuple, common.sample_texts(docs, sample).collect())) == [(1, 1, "a"), (2, 0, "")]


def test_languages_of_awkward_rows(spark):
    rows = [(i, speech(x := "aa bb".split()[i % 2], 30, i), x, "s", 1) for i in range(60)]
    model = language_id.train(spark.createDataFrame(rows, SCHEMA))
    got = language_id.identify(frame(spark), model).collect()
    assert len(got) == len(awkward())
    for r, (_, t, *_) in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(awkward(), key=lambda r: str(r[0])), strict=True):
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("aa", "bb", "und")
        del t
    by = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is not None}
    assert by[4] == by[5] == by[6] == by[9] == "und" and by[10] != "und"
    empty = language_id.train(frame(spark, []))
    assert {r["lang_pred"] for r in language_id.identify(frame(spark), empty).collect()} == {"und"}
    assert language_id.identify(frame(spark, []), model).count() == 0


# --- quality -------------------------------------------------------------------------------------------------------


def essays(n):
    r = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdk" for b in "aeo" for c in "lnrst"]
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        w = [r.choice(vocabulary) for _ in range(r.randrange(20, 120))]
        if not good:
            w = [x + r.choice(["###", "$$$", "|"]) for x in w] if i % 8 else [x for x in w[:6] for _ in range(12)]
        rows.append((i, " ".join(w) + ".", "en", "s", 1))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = essays(500)
    got = quality_classifier.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in held]) > 0.95
    again = {r["doc_id"]: r["score"] for r in quality_classifier.classify(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 0.05 for r in got)


def test_probabilities_are_calibrated(spark):
    """Where labels are half chance, scores say so: among rows of about a score, so many are good."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["ba", "bo", "da", "do"] if i % 2 else ["ka", "ko", "ga", "go"]) for _ in range(40)), "en", "s", 1) for i in range(1500)]
    labels = [(i, int(r.random() < (0.9 if i % 2 else 0.3)), 0) for i in range(1500)]
    got = {x["doc_id"]: x["score"] for x in quality_classifier.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    for odd, share in ((1, 0.9), (0, 0.3)):
        assert abs(np.mean([got[i] for i in held if i % 2 == odd]) - share) < 0.1
    loss = -np.mean([np.log(got[i] if labels[i][1] else 1 - got[i]) for i in held])
    assert loss < 0.62, loss  # 0.47 at best, 0.69 for guessing


def test_labels_of_held_out_rows_arent_read(spark):
    rows, labels = essays(200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    score = lambda x: {r["doc_id"]: round(r["score"], 6) for r in quality_classifier.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(x, LABELS)).collect()}
    assert score(labels) == score(flipped)


def test_quality_of_awkward_rows(spark):
    rows, labels = essays(100)
    df = frame(spark, rows + [(1000 + i, t, None, None, None) for i, (_, t, *_) in enumerate(awkward())])
    odd = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (7, 1, 1)], LABELS).withColumn("text", F.lit("clash"))
    got = quality_classifier.classify(df, odd).collect()
    assert len(got) == 100 + len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    none = quality_classifier.classify(df, odd.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    kept = quality_classifier.drop_rejected(df, odd)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality_classifier.classify(frame(spark, []), odd).count() == 0


def test_pooling_of_one_document_alone_and_among_others():
    table = np.random.default_rng(1).normal(size=(quality_classifier.ROWS, quality_classifier.DIM)).astype(np.float32)
    texts = ["one two two", "", "### a1 b2", "x"]
    pool = lambda ts: quality_classifier.pooled(table, np.frombuffer("".join(ts).encode(), np.uint8), np.cumsum([0, *map(len, ts)]))
    every = pool(texts)
    assert np.allclose(every, np.concatenate([pool([t]) for t in texts]), atol=1e-5) and not every[1].any()


# --- toxicity ------------------------------------------------------------------------------------------------------

BAD = ["idiot", "moron", "scum", "loser"]


def rants(n, disguise=lambda w, r: w):
    r = random.Random(7)
    clean = [f"{a}{b}{c}" for a in ("th", "re", "st", "mo") for b in ("in", "er", "or", "id") for c in ("g", "nt", "s", "")]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(clean) for _ in range(r.randrange(10, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), disguise(r.choice(BAD), r))
        rows.append((i, " ".join(w) + ".", "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows, labels = rants(600)
    docs = spark.createDataFrame(rows, SCHEMA)
    return toxicity.train(docs, spark.createDataFrame(labels, LABELS))


def disguise(w, r):
    kind = r.randrange(4)
    if kind == 0:
        return w.replace("i", "1").replace("o", "0").replace("s", "$")
    if kind == 1:
        return " ".join(w)
    if kind == 2:
        k = r.randrange(len(w))
        return w[:k] + w[k] * 4 + w[k + 1 :]
    return ".".join(w)


def plain_grams(texts):
    """4-grams of texts by the definition: small letters, one digit, any other sign a border, three borders around."""
    counts = Counter()
    for t in texts:
        raw = re.sub("[À-Þ]", lambda m: m.group().lower() if m.group() != "×" else "÷", t).encode()
        kept = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 for b in raw)
        kept = b"   " + re.sub(b" +", b" ", kept).removeprefix(b" ") + b"   "
        counts.update(kept[i : i + 4] for i in range(len(kept) - 3))
    return counts


def model_of(texts):
    counts = plain_grams(texts)
    keys = sorted(counts)
    return toxicity.CharModel(np.array([int.from_bytes(k, "big") for k in keys], np.int64), np.array([counts[k] for k in keys], np.int64))


def plain_cost(counts, text):
    """The model's cost of a text, from counts of 4-grams alone."""
    data, total = b"   " + text.encode() + b" ", 0.0
    for i in range(3, len(data)):
        p = 1 / 256
        for order in (1, 2, 3, 4):
            gram = data[i - order + 1 : i + 1]
            seen = sum(n for g, n in counts.items() if g.endswith(gram))
            of = sum(n for g, n in counts.items() if g[:-1].endswith(gram[:-1]))
            p = (seen + toxicity.BACK_OFF * p) / (of + toxicity.BACK_OFF) if of else p
        total -= math.log(p)
    return total


def plain_lattice(token):
    """All readings of each character, written down anew: letters, digits, signs that may be letters, other signs."""
    out = []
    for i, c in enumerate(token):
        times = 1
        while i - times >= 0 and token[i - times] == c:
            times += 1
        if c.isalpha():
            out.append({c: 0.0} if times == 1 else {c: 0.0, "": 3.0 if times == 2 else 0.2})
        elif c.isdigit():
            out.append({x: 0.7 for x in {"0": "o", "1": "il", "3": "e", "6": "gb"}[c]} | {c: 2.5, "": 9.0 if times == 1 else 3.1})
        elif c in "$!|":
            out.append({x: 0.7 for x in {"$": "s", "!": "il", "|": "li"}[c]} | {" ": 2.5, "": 3.0 if times == 1 else 0.1})
        else:
            out.append({" ": 0.3, "": 0.5 if times == 1 else 0.1})
    return out


def plain_best(cells, counts):
    best = (math.inf, "")
    for path in itertools.product(*[list(c) for c in cells]):
        text = re.sub(" +", " ", "".join(path)).removeprefix(" ")
        cost = sum(c[x] for c, x in zip(cells, path, strict=True)) + plain_cost(counts, text.rstrip(" "))
        best = min(best, (round(cost, 9), " ".join(text.split())))
    return best[1]


def test_viterbi_against_all_paths():
    texts = ["silly", "kill bill", "gig", "scum idiot", "illicit"] * 30
    counts, model = plain_grams(texts), model_of(texts)
    for word in ("s1l1y", "s11ly", "1ll1c1t", "k11l", "6!11", "b|1l", "g16", "s#1lly", "kiill", "$cum", "sc#um", "!6", "id--10t", "kill.b1ll", "xyz1", ""):
        assert toxicity.decode(toxicity.lattice(word), model) == plain_best(plain_lattice(word), counts), word
    for run in ("s c u m", "k 1 l l", "k i l l b", "i d 1 o t"):
        cells = [x for c in run.split() for x in ({"": 0.0, " ": 0.0}, *plain_lattice(c))][1:]
        assert toxicity.decode(toxicity.apart(run), model) == plain_best(cells, counts), run
    assert toxicity.decode(toxicity.lattice("1ll1c1t"), model) == "illicit" and toxicity.decode(toxicity.lattice("s11ly"), model) == "silly"


def test_character_model_counts_all_texts(spark):
    texts = ["Ab, ab  c4t", "", "ÉTÉ été\u20ac", "x" * 5000 + " y", None]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    model, counts = toxicity.char_model(docs), plain_grams([t or "" for t in texts])
    got = {int(k).to_bytes(4, "big"): int(n) for k, n in zip(model.keys, model.counts, strict=True)}
    # a text without any letter has its borders too
    assert {k: n for k, n in got.items() if k.strip()} == {k: n for k, n in counts.items() if k.strip()}
    few = toxicity.char_model(docs, most=3)
    assert len(few.keys) == 3 and few.counts.min() >= sorted(got.values())[-3]
    state, cost = model.step(toxicity.START, "a")
    assert state == 0x202061 and cost > 0 and model.step(toxicity.START, " ") == (toxicity.START, 0.0)


def test_disguised_words_are_restored(toxic_model):
    chars = toxic_model.chars
    long = {"idi" + "o" * 60 + "t": "idiot", "i" + "*" * 50 + "diot": "idiot", "#-" * 30 + "m0r0n": "moron", "s" * 45 + "cum": "scum"}
    cases = {"1d10t": "idiot", "m0r0n": "moron", "$cum": "scum", "loooooser": "loser", "M.O.R.O.N": "moron", "fine,": "fine", "stiing": "sting", "idio+": "idiot", "idiot!!": "idiot", "2024": "2024", "--": "", "...": "", "thing***": "thing"} | long
    assert {t: toxicity.restored_token(t, chars) for t in cases} == cases
    assert set(toxicity.restored_token("/".join(["thing-reor"] * 4 + ["idi0t", "m0ron"]), chars).split()) >= {"idiot", "moron"}
    assert len(toxicity.restored_token("x3" * 100_000, chars)) >= 100_000
    restorer = toxicity.Restorer(chars)
    runs = {"you i d i o t now": "you idiot now", "i d i o t s c u m": "idiot scum", "l o $ e r": "loser", "m\to\tr\to\tn": "moron", "m\no\nr\no\nn": "moron", "i. d. i. o. t": "idiot", "a b": "a b", "i d i": None}
    for text, want in runs.items():
        assert want is None or restorer.text(text) == want, text
    assert restorer.text("The  1d10t,\nthing") == "the  idiot\nthing"


def test_toxicity_by_a_plain_version(spark):
    """The whole operator again: words of restored texts, their weights, the curve and the scores."""
    rows, labels = rants(150, disguise)
    docs, marks = spark.createDataFrame([*rows, *rows[:5]], SCHEMA), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r["score"] for r in toxicity.detect(docs, marks).collect()}
    model = model_of([t for _, t, *_ in [*rows, *rows[:5]]])
    check = {r["doc_id"]: r["c"] for r in docs.select("doc_id", (F.xxhash64("doc_id", F.lit(29)) % 3 == 0).alias("c")).collect()}
    found = {i: {f for t in toxicity.Restorer(model).joined(t).split() for w in toxicity.restored_token(t, model).split() for f in (w, *(f"{w[:n]}~" for n in (4, 5, 6) if len(w) > n))} for i, t, *_ in rows}
    one = {i: {w: {w, *(f"{w[:n]}~" for n in (4, 5, 6) if len(w) > n)} for t in toxicity.Restorer(model).joined(text).split() for w in toxicity.restored_token(t, model).split()} for i, text, *_ in rows}
    learn = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1]

    def weights(ids):
        clean, toxic = (Counter(f for i in ids if labels[i][2] == k for f in found[i]) for k in (0, 1))
        n = [sum(labels[i][2] == k for i in ids) for k in (0, 1)]
        base, out = (n[1] + 1) / (sum(n) + 2), {}
        for f, t in toxic.items():
            c = clean[f]
            share = t / (t + c)
            surprise = t * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0)
            odds = math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
            if t >= 2 and share > base and odds > 1.5 and surprise > 6:
                out[f] = odds * min(1, surprise / 12) ** 2
        return out

    def measure(i, w):
        hits = [x for x in (max((w.get(f, 0.0) for f in fs), default=0.0) for fs in one[i].values()) if x]
        return (max(hits), math.log1p(sum(hits) - max(hits))) if hits else (0.0, 0.0)

    w = weights([i for i in learn if not check[i]])
    held = sorted((labels[i][2], *measure(i, w)) for i in learn if check[i])
    a, b, c = toxicity._curve(np.array([h[1:] for h in held]), np.array([float(h[0]) for h in held]))
    w = weights(learn)
    for i, *_ in rows:
        x, y = measure(i, w)
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, a + b * x + c * y))))) < 1e-6, i


def test_restored_texts(spark, toxic_model):
    got = toxicity.restore(frame(spark), toxic_model.chars).collect()
    assert len(got) == len(awkward()) and {r["restored"] for r in got if r["doc_id"] in (4, 5)} == {""}
    rows, _ = rants(40, disguise)
    docs = spark.createDataFrame(rows, SCHEMA)
    restored = toxicity.restore(docs, toxic_model.chars).withColumnRenamed("restored", "text")
    score = lambda df: {r["doc_id"]: round(r["score"], 9) for r in toxicity.score(df, toxic_model).collect()}
    assert score(docs) == score(restored)


def test_toxicity_on_held_out_and_disguised_rows(spark, toxic_model):
    for change in (lambda w, r: w, disguise):
        rows, labels = rants(300, change)
        got = toxicity.score(spark.createDataFrame(rows, SCHEMA), toxic_model).collect()
        predicted = {r["doc_id"]: r["score"] >= 0.7 for r in got}
        caught = np.mean([predicted[i] for i, _, t in labels if t])
        wrong = np.mean([predicted[i] for i, _, t in labels if not t])
        assert caught > 0.93 and wrong < 0.02, (caught, wrong)


def test_toxicity_of_awkward_rows(spark, toxic_model):
    got = toxicity.score(frame(spark), toxic_model).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] < 0.7 for r in got)
    assert toxicity.score(frame(spark, []), toxic_model).count() == 0
    none = toxicity.detect(frame(spark), spark.createDataFrame([(None, None, None)], LABELS)).collect()
    assert {r["predicted"] for r in none} == {0}


def _plain_labels(model, text):
    """Label probabilities of each word by sums over all neighbours, one word after another."""
    words = text.split()
    k = len(model.labels)
    e = [np.exp(model.emissions([language_id.letters(w)])[0]) if language_id.letters(w) else np.ones(k) for w in words]
    a = np.exp(model.transitions)
    forward, backward = [e[0]], [np.ones(k)]
    for x in e[1:]:
        forward.append(x * sum(forward[-1][i] * a[i] for i in range(k)))
        forward[-1] = forward[-1] / forward[-1].sum()
    for x in e[:0:-1]:
        backward.append(sum(a[:, j] * x[j] * backward[-1][j] for j in range(k)))
        backward[-1] = backward[-1] / backward[-1].sum()
    p = np.array([f * b for f, b in zip(forward, backward[::-1], strict=True)])
    return p / p.sum(1, keepdims=True), [bool(language_id.letters(w)) for w in words]


def test_languages_against_a_plain_version(spark):
    """Every prediction, score and span of the operator, from a plain chain over the words; all words are learned from."""
    one, two = ["lorem", "ipsum", "dolor", "amet"], ["kvik", "brun", "raev", "hopper"]
    long = " ".join(one * 100 + ["zzyzx"] * 4)
    rows = [(i, " ".join((one if i % 2 else two)[(i + j) % 4] for j in range(40)), "a" if i % 2 else "b") for i in range(40)]
    docs = spark.createDataFrame([*rows, (1000, long, "a"), (1001, long, "a"), (1002, long, "a")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    words = model.emissions(["zzyzx"])[0]
    assert words[0] > words[1]  # the last words of a long text count
    mixed = [(1, "lorem ipsum dolor 12 brun raev hopper kvik"), (2, "-- hopper"), (3, "..."), (4, None), (5, "")]
    asked = spark.createDataFrame(mixed, "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(asked, model).collect()}
    spans = {r["doc_id"]: r["spans"] for r in language_id.label_spans(asked, model).collect()}
    for i, text in mixed:
        if i > 2:
            assert (got[i]["lang_pred"], got[i]["score"], spans[i]) == ("und", 0.0, [])
            continue
        p, real = _plain_labels(model, text)
        share = p[real].sum(0)
        assert got[i]["lang_pred"] == model.labels[share.argmax()]
        assert abs(got[i]["score"] - share.max() / share.sum()) < 1e-9
    assert [(mixed[0][1][s["start"] : s["start"] + s["length"]], s["label"]) for s in spans[1]] == [("lorem ipsum dolor 12", "a"), ("brun raev hopper kvik", "b")]
    assert [(s["start"], s["length"], s["label"]) for s in spans[2]] == [(3, 6, "b")]
    assert all(0.5 <= s["probability"] <= 1 for found in spans.values() for s in found)
