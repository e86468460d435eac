import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from sparkgauge.llm import simhash, source_audit, whitening
from tests.llm.helpers import SCHEMA, awkward, frame, sentence, words


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Source divergence


def audited(rows, least, top=50):
    """The audit term by term, for every pair."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for _, t, lang, source, *_ in rows]
    share = lambda n, total, v: 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)
    out = []
    for lang in {d[0] for d in docs}:
        df, counts = Counter(), {}
        for here, source, terms in docs:
            if here == lang:
                df.update(set(terms))
                counts.setdefault(source, Counter()).update(terms)
        kept = [t for t, n in df.items() if n >= least]
        of = {s: [c[t] for t in kept] for s, c in counts.items()}
        p = {s: [share(n, sum(x), len(kept)) for n in x] for s, x in of.items()}
        whole = [sum(x[i] for x in of.values()) for i in range(len(kept))]
        q = [share(n, sum(whole), len(kept)) for n in whole]
        for s in of:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in of if o != s)
            terms = sorted((b - a, t.encode()) for a, b, n, t in zip(p[s], q, of[s], kept, strict=True) if n and a > b)[:top]
            out += [(lang, s, "pair", item.decode(), -v, k + 1) for k, (v, item) in enumerate(pairs)]
            out += [(lang, s, "term", item.decode(), -v, k + 1) for k, (v, item) in enumerate(terms)]
    return sorted(out)


def mixed(n=80):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("Ab", "cd", "ñe", "漢") for b in "abcdefgh"]
    return [(i, " ".join(rng.choice(vocabulary[: 8 + i % 24]) for _ in range(rng.randrange(40))) + " 12-x_y", rng.choice(["en", "de", None]), rng.choice(["a", "b", "Z", "ä", None, ""]), 1) for i in range(n)]


def test_audit(spark):
    rows = [*mixed(), *awkward(), (99, "1 2 3", "no words", "here", 0), (98, None, "no words", "there", 0), (97, "one only", "xx", "s", 0)]
    for least, top in ((1, 50), (5, 3), (10**6, 50)):
        got = source_audit.divergence(frame(spark, rows), least_docs=least, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
        assert sorted(map(tuple, got.collect())) == audited(rows, least, top)
    assert source_audit.divergence(frame(spark, [])).count() == 0


def test_audit_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "BLOCK", 3)
    monkeypatch.setattr(source_audit, "PAIRS", 2)
    assert sorted(map(tuple, source_audit.divergence(frame(spark, mixed()), least_docs=1).collect())) == audited(mixed(), 1)


def test_joint_tallies_hold_pairs_of_chunks(monkeypatch):
    rng = random.Random(2)
    cells = [(t, g, rng.randrange(1, 4)) for t in "abcdefg" for g in range(6) if rng.random() < 0.7]
    want = Counter((a, b, x, y) for t in "abcdefg" for a, x in {(g, n) for s, g, n in cells if s == t} for b, y in {(g, n) for s, g, n in cells if s == t} if a < b)
    for pairs in (1, 4, 1 << 20):
        monkeypatch.setattr(source_audit, "PAIRS", pairs)
        got = Counter()
        for r in source_audit._joint(pa.table(dict(zip(("term", "g", "n"), map(list, zip(*cells, strict=True)), strict=True)))).to_pylist():
            got[r["a"], r["b"], r["x"], r["y"]] += r["m"]
        assert got == want


def test_shares_of_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total = 9_999_999_999_999, 10**18
    assert spark.range(1).select(source_audit.share(F.lit(n), F.lit(total), F.lit(12345))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * 12345)


# Whitening


def plain(vectors, components=4):
    """n, each vector's exact deviation, and whitened vectors, by whole numbers and one eigh."""
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    distinct = [list(t) for t in {tuple(v) for v in x}]
    n, d = len(distinct), len(x[0])
    s = [sum(v[i] for v in distinct) for i in range(d)]
    v = np.array([[sum((n * a[i] - s[i]) * (n * a[j] - s[j]) for a in distinct) / n**3 for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    z = [[n * a - b for a, b in zip(w, s, strict=True)] for w in x]
    return n, [sum(a * a for a in w) for w in z], np.array(z, float) / n @ q / np.sqrt(e), e / np.trace(v)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(200, 6)) @ np.diag([3, 2, 1, 0.5, 0.2, 0.1])).astype(np.float32).tolist()
    vectors += vectors[:50] + [vectors[3]] * 40
    rows = [(i if i % 7 else None, v, "clash") for i, v in enumerate(vectors)]
    bad = [(900, None, "x"), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (902, [float("nan")] * 6, "x"), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], None), (904, [], "x")]
    got = whitening.whiten(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n string")).toPandas()
    n, deviations, w, explained = plain(vectors)
    assert len(got) == 4 * len(vectors) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert Counter(int(v) for v in got.loc[got["component"] == 1, "deviation"]) == Counter(deviations)
    for k in range(4):
        mine = got[got["component"] == k + 1]
        assert np.allclose(np.sort(np.abs(mine["whitened"])), np.sort(np.abs(w[:, k])), rtol=1e-9, atol=1e-11)
        assert np.allclose(mine["explained"], explained[k], rtol=1e-9)
    assert got["vec_id"].isna().sum() == 4 * sum(i is None for i, *_ in rows)


def test_whitening_where_little_varies(spark):
    frames = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frames([])).count() == 0 and whitening.whiten(frames([(1, None), (2, [])])).count() == 0
    one = whitening.whiten(frames([(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert len(one) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)
    # a flat direction, and vectors of another length
    got = whitening.whiten(frames([(i, [i / 8, -i / 8, 0.0]) for i in range(5)] + [(9, [1.0]), (8, [2.0])])).toPandas()
    assert sorted(got.groupby("vec_id").size()) == [1, 1, 3, 3, 3, 3, 3]
    line = got[got["vec_id"] < 8]
    assert np.allclose(line.loc[line["component"] == 1, "explained"], 1) and line.loc[line["component"] > 1, "whitened"].isna().all() and (line["identity_error"] < 1e-9).all()
    assert sorted(got.loc[got["vec_id"] >= 8, "whitened"].round(9)) == [-1, 1]


@pytest.mark.parametrize("size", [1.0, 1e5, 1e12, 1e18, 1e30])
def test_scatter_is_exact_at_every_size(spark, size):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(40, 3)) * size).tolist()
    column = pa.array(vectors)
    ((rows, x),) = whitening.vectors(column)
    assert len(rows) == 40 and all(int(a) == max(min(int(np.floor(256 * b)), 2**63 - 1), -(2**63)) for u, v in zip(x, vectors, strict=True) for a, b in zip(u, v, strict=True))
    shift = x[0].astype(object)
    s, c = whitening.scatter(x, shift)
    y = [[int(a) - int(b) for a, b in zip(row, shift, strict=True)] for row in x]
    assert list(s) == [sum(r[i] for r in y) for i in range(3)]
    assert all(c[i][j] == sum(r[i] * r[j] for r in y) for i in range(3) for j in range(3))
    got = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).toPandas()
    distinct = {tuple(map(int, r)) for r in x}
    n, sums = len(distinct), [sum(r[i] for r in distinct) for i in range(3)]
    want = {i: sum((n * int(a) - b) ** 2 for a, b in zip(r, sums, strict=True)) for i, r in enumerate(x)}
    assert all((None if pd.isna(d) else int(d)) == (want[i] if want[i] < 10**38 else None) for i, d in zip(got["vec_id"], got["deviation"], strict=True))


# SimHash


def fingerprint(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode("utf-8", "surrogateescape"), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def connected(fps, bits=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= bits:
            parent[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return sorted(map(sorted, groups.values()))


def test_triples_meet_every_four_positions():
    found = simhash.triples()
    assert len(found) == 20 and all(any(set(t) <= set(four) for t in found) for four in combinations(range(8), 4))


def test_simhash(spark):
    base = sentence(7, 400)
    near = [(50 + k, base.replace("w1 ", f"w{k} ", 1 + k % 2), "en", "s", 1) for k in range(12)]
    rows = [*awkward(), *near, (80, base.upper(), "en", "s", 1), (81, base.replace(" ", "\t\n "), "en", "s", 1), (82, "one two", None, None, 1)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    of = [(i, fingerprint(t)) for i, t, *_ in rows]
    groups = connected({f for _, f in of})
    least = {f: min((i for i, g in of if g in group and i is not None), default=None) for group in groups for f in group}
    size = {f: sum(g in group for _, g in of) for group in groups for f in group}
    assert Counter(map(tuple, got)) == Counter((i, f"{f:016x}", least[f], size[f]) for i, f in of)
    assert next(f for i, f in of if i == 80) == fingerprint(base)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    lonely = simhash.near_duplicates(spark.createDataFrame([(None, "a b", None, None, 1), (None, "a b", None, None, 1)], SCHEMA)).collect()
    assert [(r["doc_id"], r["component_id"], r["group_size"]) for r in lonely] == [(None, None, 2)] * 2


def test_texts_that_arent_utf8(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, b"caf\xe9 \xff\xfe one two three"), (2, b"caf\xe9 \xff\xfe one two three")], "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    got = simhash.near_duplicates(rows).collect()
    assert len({r["fingerprint"] for r in got}) == 1 and {r["component_id"] for r in got} == {1}


@pytest.mark.parametrize(("block", "large"), [(2_048, 32_768), (16, 1 << 30), (16, 64)])
def test_links_connect_balls_and_chains(spark, block, large):
    """Blocks at once, pairs of blocks, and midpoints: the same groups as comparing all pairs."""
    rng = random.Random(3)
    fps = set()
    for centre in [rng.getrandbits(64) for _ in range(2)]:
        for _ in range(200):
            x = centre
            for _ in range(rng.randrange(8)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    x = rng.getrandbits(64)
    for _ in range(60):
        fps.add(x)
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    found = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), 4, block, large).collect()
    parent = {f: f for f in fps}

    def find(v):
        return v if parent[v] == v else find(parent[v])

    for r in found:
        a, b = (v % (1 << 64) for v in (r["a"], r["b"]))
        parent[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == connected(fps)


def test_other_bits():
    with pytest.raises(ValueError):
        simhash.links(None, 6)
