import hashlib
import itertools
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.llm import mixing, quality_rules, url_filter
from sparkgauge.llm.queries import URL_RULES
from tests.llm.helpers import SCHEMA, awkward, frame, words

# --- URL rules -----------------------------------------------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def plain_verdict(url, rules=URL_RULES):
    host, path = plain_parts(url)
    best = None
    for rule in rules:
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
            best = rule
    return host, path, best.text if best else None, best.action if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com/en/", "https://A.Example.COM/en/7x?y", "http://example.com/en/8", "http://xexample.com/en/7", "http://net/de/8", "http://a.example.net/de/8", "http://example.net/de/7#/de/8", "http://org/es/", "http://a.org/es",
    "http://a.org/x.com/en/", "http://x.com:80/en/", "http://x.com?/en/", "http://é.COM/en/ñ", "http://a.com/EN/", "x://y://com/en/", "http://com/en/" + "z" * 5000, "http://" + "a." * 3000 + "net/de/", "http://.com/en/", "http:///en/", "http://a b.org/es/q", "http://a.b\nc.org/es/",
]


def test_urls_against_the_plain_rules(spark):
    random.seed(0)
    bits = ["com", "net", "org", "example", "a", ".", "/", "en", "de", "es", "7", "8", "?", "#", "://", "X"]
    urls = URLS + ["http://" + "".join(random.choice(bits) for _ in range(random.randrange(1, 12))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("_url", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, URL_RULES).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, (), "block").collect()} == {"block"}


def test_globs_and_many_words():
    rules = [url_filter.Rule("block", f"site{i}.example", f"/p{i}/*/end") for i in range(40)] + [url_filter.Rule("allow", "s*.cdn", "/")]
    automaton = url_filter.Automaton(rules)
    assert automaton.words > 10
    cases = {"site7.example/p7/x/y/end": 7, "a.site39.example/p39//end!": 39, "site7.example/p7/x/en": -1, "s12.cdn/": 40, "x.sab.cdn/q": 40, "s/.cdn/": -1, "site1.example/p2/x/end": -1}
    data, offsets = np.frombuffer("".join(cases).encode(), np.uint8), np.cumsum([0, *map(len, cases)])
    assert automaton.best(data, offsets).tolist() == list(cases.values())


# --- quality rules -------------------------------------------------------------------------------------------------


def plain_bad(x, size, letters, symbols):
    """The rules of a line without regular expressions."""
    marks, closing, space = ".!?…。．！？｡؟۔।॥։።", "\"'”’»›)]}」』", " \t\n\v\f\r"
    start = x.strip(space)
    bare = start.rstrip(closing)
    ends, cut = bare[-1:] in tuple(marks), bare.endswith(("...", "…"))
    digits = len(start) - len(start.lstrip("0123456789"))
    bullet = (start[:1] in tuple("•‣▪●○◦·–—*-") and start[1:2] in (" ", "\t")) or (1 <= digits <= 3 and start[digits : digits + 1] in (".", ")") and start[digits + 1 : digits + 2] in (" ", "\t"))
    items = sum(c in "|•·»›→" for c in x)
    year = lambda t: len(t[:4]) == 4 and all(c in "0123456789" for c in t[:4])
    rights = any(c in x for c in "©®™") or any(x[i : i + 3].lower() == "(c)" and year(x[i + 3 :].lstrip(space)) for i in range(len(x)))
    link = len(words(x)) == 1 and start.startswith(("http://", "https://", "www."))
    if not ends and (size <= 200 or not any(m in x for m in marks) or bullet):
        return True
    return (ends and cut) or letters * 2 < size or symbols * 10 > size or (items >= 3 and size <= 20 * (items + 1)) or (size <= 200 and (rights or link))


def plain_quality(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 50 or len(covered) * 100 > len(w) * 50
    lost = 0
    for x in lines:
        size, letters, symbols = sum(map(len, words(x))), sum(c.isalpha() for c in x), sum(c in quality_rules.SYMBOLS for c in x)
        lost += size * plain_bad(x, size, letters, symbols)
    total = sum(map(len, w))
    return len(w), total, sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), failed, not failed and lost <= 0.5 * total


def test_quality_rules(spark):
    random.seed(4)
    vocabulary = ["alpha", "beta", "x#", "|", "12", "alpha.", "beta!\n", "ñandú", "\n", "Home | About |", "so...\n", "\n• item", "\n3) item", "© 2020", "(c) 1999", "\nhttp://a.b/c\n", "end.”\n", "終わり。\n", "long " * 60]
    texts = [t for _, t, *_ in awkward()] + [" ".join(random.choice(vocabulary[: random.randrange(2, 20)]) for _ in range(random.randrange(0, 300))) for _ in range(150)] + [" ".join(f"u{i}" for i in range(400)) + " " + "again and again " * k for k in (0, 1, 2, 40)]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(df).collect()}
    assert got == {i: plain_quality(t) for i, t in enumerate(texts)}
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


def test_cleaned_text_drops_failed_lines(spark):
    good = ["A line of plain prose that stays.", "Une autre ligne qui reste !", "• A bullet that is a sentence.", "これは文です。", "Said \"so.\"", "long words here. " + "and on " * 60]
    bad = ["Home | About | Contact |", "#### $$$$ ####", "Sign up", "Read on ...", "• buy milk", "© 2021 Someone.", "www.example.com/a.", "12. 34. 56.", "words " * 90]
    text = "\n".join(x for pair in zip(good, bad) for x in pair) + "\n" + "\n".join(bad[len(good) :])
    row = quality_rules.quality_rules(frame(spark, [(1, text, None, None, None)])).first()
    assert row["cleaned"] == "\n".join(good) and 0 < row["lost_share"] < 1


def test_quality_rules_stay_in_the_jvm(spark):
    plan = quality_rules.quality_rules(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


# --- mixing --------------------------------------------------------------------------------------------------------


def pour(budget, nodes):
    """{name: whole tokens} of siblings (name, capacity, weight): shares, and what doesn't fit to the others, again and again."""
    full, open_ = {}, {n: (c, w) for n, c, w in nodes if w > 0}
    while open_:
        rest, weight = budget - sum(full.values()), sum(w for _, w in open_.values())
        over = [n for n, (c, w) in open_.items() if c <= Fraction(rest * w, weight)]
        if not over:
            return {n: 0 for n, _, _ in nodes} | full | {n: min(c, rest * w // weight) for n, (c, w) in open_.items()}
        for n in over:
            full[n] = open_.pop(n)[0]
    return {n: 0 for n, _, _ in nodes} | full


def plain_budgets(leaves, levels, share, epochs):
    total = int(float(sum(leaves.values())) * share)

    def down(prefix, budget):
        k = len(prefix)
        if k == len(levels):
            return {prefix: budget}
        caps = defaultdict(int)
        for leaf, n in leaves.items():
            if leaf[:k] == prefix:
                caps[leaf[k]] += n * epochs
        given = pour(budget, [(n, c, levels[k].weights.get(n, levels[k].default)) for n, c in caps.items()])
        return {leaf: b for n, x in given.items() for leaf, b in down((*prefix, n), x).items()}

    return down((), total)


LEVELS = (mixing.Level("d", {"a": 5, "b": 1, "z": 0}), mixing.Level("l", {"en": 3}), mixing.Level("s"))


def test_budgets_against_repeated_sharing(spark):
    random.seed(8)
    for share, epochs in itertools.product((0.1, 0.7, 1.5), (1, 3)):
        leaves = {(d, x, s): random.choice([0, 1, 7, 100, 5000]) for d in "abz" for x in ("en", "de") for s in ("s1", "s2", "s3") if random.random() < 0.8}
        df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "d string, l string, s string, available long")
        got = {(r["d"], r["l"], r["s"]): r["budget"] for r in mixing.budgets(df, LEVELS, share, epochs).collect()}
        assert got == plain_budgets(leaves, LEVELS, share, epochs), (share, epochs)


def test_shortage_goes_to_siblings_before_the_parents(spark):
    df = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("b", "en", "s1", 1000)], "d string, l string, s string, available long")
    got = {(r["d"], r["s"]): r["budget"] for r in mixing.budgets(df, (mixing.Level("d"), mixing.Level("l"), mixing.Level("s")), 1000 / 2010, 1).collect()}
    assert got == {("a", "s1"): 10, ("a", "s2"): 490, ("b", "s1"): 500}


def plain_mix(rows, levels, share, epochs, seed):
    """(key, epoch) of what is taken; rows: (key, levels..., tokens)."""
    leaves = defaultdict(int)
    for _, *leaf, n in rows:
        leaves[tuple(x or "" for x in leaf)] += n or 0
    out = []
    for leaf, budget in plain_budgets(leaves, levels, share, epochs).items():
        own = [(k, n or 0) for k, *x, n in rows if tuple(y or "" for y in x) == leaf]
        whole, part = divmod(budget, leaves[leaf]) if leaves[leaf] else (0, 0)
        out += [(k, e) for k, _ in own for e in range(whole)]
        total = 0
        order = sorted((hashlib.md5(f"{seed}|{whole}|{'' if k is None else k}".encode()).hexdigest(), n, k if k is not None else -1) for k, n in own)
        for (_, n), peers in itertools.groupby(order, lambda x: x[:2]):
            peers = list(peers)
            total += n * len(peers)
            if part and total <= part:
                out += [(None if k == -1 else k, whole) for _, _, k in peers]
    return sorted(out, key=str)


CLASHES = ("_n", "_level0", "_leaf", "_part", "_whole", "_order", "_all", "_key", "_upto", "_end", "_epochs", "l0", "row", "budget", "available")


def test_mix_against_the_plain_version(spark):
    random.seed(6)
    rows = [(i if i % 50 else None, random.choice(["a", "a", "b", "z", None]), random.choice(["en", "de", None]), random.choice(["s1", "s2"]), random.choice([None, 0, 1, 5, 40])) for i in range(1, 700)]
    rows += [(900, "a", "en", "s1", 5)] * 3
    df = spark.createDataFrame(rows, "doc_id long, d string, l string, s string, _tokens int").withColumns({c: F.lit("clash") for c in CLASHES})
    for share, epochs in ((0.5, 1), (0.9, 3)):
        got = mixing.mix(df, LEVELS, share, epochs, 3)
        assert sorted(((r["doc_id"], r["_epoch"]) for r in got.collect()), key=str) == plain_mix(rows, LEVELS, share, epochs, 3)
        assert got.columns == [*df.columns, "_epoch"]
        assert all({r[c] for r in got.select(c).distinct().collect()} == {"clash"} for c in CLASHES) and got.where("_tokens > 40").isEmpty()
    again = mixing.mix(df.withColumn("_epoch", F.lit("old")), LEVELS, share, epochs, 3)
    assert again.columns == got.columns and again.count() == got.count()
    assert mixing.mix(df.limit(0), LEVELS).count() == 0


def test_domains_and_tokens(spark):
    df = spark.createDataFrame([("src6",), ("x",), (None,), ("n99999999999999",)], "source string")
    assert [r["d"] for r in df.select(mixing.domain().alias("d")).collect()][:3] == ["d2", "other", "other"]
    docs = spark.createDataFrame(awkward(), SCHEMA)
    assert [r["n"] for r in docs.select(mixing.n_tokens().alias("n")).collect()] == [len(words(t)) for _, t, *_ in awkward()]


@pytest.mark.parametrize("share", [0.0, 5.0])
def test_extreme_budgets(spark, share):
    df = spark.createDataFrame([(1, "a", "en", "s", 3), (2, "b", "en", "s", 4)], "doc_id long, d string, l string, s string, _tokens int")
    got = sorted((r["doc_id"], r["_epoch"]) for r in mixing.mix(df, LEVELS, share, 2).collect())
    assert got == ([] if share == 0 else [(1, 0), (1, 1), (2, 0), (2, 1)])
