import random

import numpy as np
import pandas as pd

from sparkgauge.llm import exact_dedup, graph, ngram_join
from tests.llm.helpers import SCHEMA, awkward, frame, normal, sentence, words


def test_fingerprints_by_definition():
    random.seed(1)
    texts = [b"", b"a", b"\0a", bytes(random.randrange(256) for _ in range(1023)), bytes(random.randrange(256) for _ in range(5000)), b"x" * 1024, b"x" * 1025]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert [tuple(map(int, r)) for r in exact_dedup.fingerprints(data, offsets)] == [exact_dedup.fingerprint(t) for t in texts]


def test_fingerprints_compose():
    a, b = b"hello " * 400, b"world" * 300
    assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b)) == exact_dedup.fingerprint(a + b)


def expected_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normal(t), []).append(i)
    return {k: (min((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(frame(spark)).collect()
    groups = expected_exact(awkward())
    import hashlib

    by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(got) == len(awkward())
    assert all((r["keep_id"], r["group_size"]) == by[r["text_sha256"]] for r in got)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(by)  # one of each group, repeated rows included
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_rows_that_stay(spark):
    got = exact_dedup.drop_copies(frame(spark))
    assert got.columns == frame(spark).columns
    assert sorted(normal(r["text"]) for r in got.collect()) == sorted(expected_exact(awkward()))
    assert exact_dedup.drop_copies(frame(spark, [])).count() == 0


def test_colliding_fingerprints_dont_merge(spark, monkeypatch):
    """With a fingerprint that is always the same, the comparison alone must tell texts apart."""
    rows = [(i, t, None, None, None) for i, t in enumerate(["ab", "cd", "ab", "ef", "cd", "ab"])]
    real = exact_dedup.fingerprint_rows
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "fingerprint_rows", lambda *a: real(*a).withColumn("_fp", F.lit(7).cast("long")))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: (0, 3, True), 1: (1, 2, True), 2: (0, 3, False), 3: (3, 1, True), 4: (1, 2, False), 5: (0, 3, False)}


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_banding_reaches_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.9999), (1.0, 0.9)):
        bands, rows = ngram_join.banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and (bands * rows <= ngram_join.MOST_HASHES)


def brute(rows, n=5, threshold=0.8):
    """(class, links) of each key, by comparing every pair."""
    sets = []
    for i, t, *_ in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    links = [0] * len(sets)
    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                links[x] += 1
                links[y] += 1
                parent[max(find(x), find(y))] = min(find(x), find(y))
    out = []
    for x, (i, s) in enumerate(sets):
        group = [sets[y][0] for y in range(len(sets)) if find(y) == find(x)]
        out.append((i, min((g for g in group if g is not None), default=None) if s else i, links[x]))
    return sorted(out, key=str)


def test_ngram_join_of_awkward_rows(spark):
    got = ngram_join.similarity_join(frame(spark)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(awkward())
    assert ngram_join.similarity_join(frame(spark, [])).count() == 0


def near_copies(seed=5):
    """A large ball of copies with more and more changes, chains, and texts that share a long passage."""
    random.seed(seed)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(330):
        w = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            w[random.randrange(len(w))] = f"z{random.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, None))
    chain = [f"c{k}" for k in range(200)]
    for i in range(12):
        chain = chain[8:] + [f"c{i}_{k}" for k in range(8)]
        rows.append((1000 + i, " ".join(chain), None, None, None))
    passage = [f"p{k}" for k in range(70)]
    rows += [(2000 + i, " ".join(passage + words(sentence(i, 40))), None, None, None) for i in range(60)]
    rows += [(3000 + i, f"short text {i % 3}", None, None, None) for i in range(9)]
    return rows


def test_ngram_join_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    rows = near_copies()
    got = ngram_join.similarity_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)


def test_rows_in_blocks_grow_with_the_classes(spark, monkeypatch):
    """Copies that are all within 0.9 of the first are counted, not compared: no block has any of them."""
    seen = []
    real = ngram_join._in_blocks
    monkeypatch.setattr(ngram_join, "_in_blocks", lambda rows, open_pairs: (seen.append(real(rows, open_pairs)), seen[-1])[1])
    base = [f"b{k}" for k in range(300)]
    for m in (60, 240):
        rows = [(0, " ".join(base), None, None, None)] + [(i, " ".join(w if k != 7 + i else f"z{i}" for k, w in enumerate(base)), None, None, None) for i in range(1, m)]
        got = ngram_join.similarity_join(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {(r["class_id"], r["n_links"]) for r in got} == {(0, m - 1)}
        assert all(placed.count() == 0 for placed, _ in seen)


def test_blocks_find_what_pairs_find():
    random.seed(9)
    sets = [np.unique(np.array([random.randrange(30) for _ in range(20)])) for _ in range(40)]
    plain = np.array([[len(set(a) & set(b)) >= 0.6 * len(set(a) | set(b)) for b in sets] for a in sets])
    own = plain.copy()
    np.fill_diagonal(own, False)
    pivot = np.unique(np.array([random.randrange(30) for _ in range(25)]))
    differ, n = [np.setxor1d(pivot, x) for x in sets], np.array([len(x) for x in sets])
    assert (ngram_join.links_between(differ, None, n, None, len(pivot), 0.6) == own).all() and (ngram_join.links_between(differ[:15], differ[15:], n[:15], n[15:], len(pivot), 0.6) == plain[:15, 15:]).all()
    rows = pd.DataFrame({"part": 1, "c": range(40), "differ": differ, "n": n, "pivot": len(pivot), "block": [0] * 15 + [1] * 25, "i": 0, "j": 1})
    edges = ngram_join._stars(0.6)(rows)
    parent = list(range(40))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges.itertuples(index=False):
        parent[find(a)] = find(b)
    mine = {tuple(y for y in range(40) if find(y) == find(x)) for x in range(40)}
    parent = list(range(40))
    for x in range(15):
        for y in range(15, 40):
            if plain[x, y]:
                parent[find(x)] = find(y)
    assert mine == {tuple(y for y in range(40) if find(y) == find(x)) for x in range(40)} and len(edges) < 40


def test_one_of_each_group_stays(spark):
    rows = near_copies()
    got = ngram_join.near_dedup(frame(spark, rows))
    groups = {c for _, c, _ in brute(rows)}
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(groups) and got.columns == frame(spark, []).columns


def test_of_repeated_rows_one_stays_whatever_their_order(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "b", "s", 1), (1, text, "a", "s", 1), (1, text, "a", "s", 1), (2, text, "c", "s", 1), (None, "null key", None, None, 1), (None, "", None, None, 1), (None, "", None, None, 1)]
    for operator in (ngram_join.near_dedup, exact_dedup.drop_copies):
        one, two = (sorted(map(str, operator(spark.createDataFrame(x, SCHEMA).repartition(3)).collect())) for x in (rows, rows[::-1]))
        assert one == two and len(one) == 3, operator
    texts = spark.createDataFrame([("", "same"), (None, "same"), ("", "other")], "doc_id string, text string")
    assert exact_dedup.drop_copies(texts).count() == 2 and ngram_join.near_dedup(texts).count() == 2
