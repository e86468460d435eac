"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, mixing
from .bpe import Bpe, load_ranks, round_trip
from .exact_dedup import exact_dedup
from .language_id import identify
from .language_id import train as train_languages
from .ngram_join import similarity_join
from .quality_classifier import classify
from .quality_rules import quality_rules
from .simhash import near_duplicates
from .source_audit import divergence
from .token_counts import Tokenizer, token_counts
from .toxicity import detect
from .url_filter import Rule, judge_urls
from .whitening import whiten

#: The rules of the URL query.
URL_RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> Bpe:
    import public_tokenizers

    return Bpe(load_ranks(vocabulary("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty with each call, so every distinct text is encoded once."""
    docs = common.read(spark, sf_dir, "documents")
    return token_counts(docs, Tokenizer.load(vocabulary("piece_bpe_32k.model")), common.scratch_path(spark, "token-cache"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = detect(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.n_tokens().alias("n_tokens"))
    mixed = mixing.mix(docs.withColumn("domain", mixing.domain()), mixing.TREE, tokens="n_tokens")
    return mixed.select("doc_id", "domain", "lang", "source", F.col("_epoch").alias("epoch"), "n_tokens")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.read(spark, sf_dir, "documents"), byte_bpe())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(common.read(spark, sf_dir, "pages"), URL_RULES)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(common.read(spark, sf_dir, "documents")).drop("_t")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.read(spark, sf_dir, "documents")).drop("cleaned", "lost_share")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = identify(docs, train_languages(docs))
    return found.select("doc_id", F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.read(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(common.read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that a long can't hold is null here, and whole in deviation_exact."""
    found = whiten(common.read(spark, sf_dir, "embeddings"))
    return found.withColumns({"deviation_exact": F.col("deviation"), "deviation": F.expr("try_cast(deviation AS bigint)")})


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents")).drop("group_size")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_token_counts, op2_toxicity, op3_source_mixing, op4_byte_bpe, op5_quality_classifier, op6_url_filters, op7_ngram_join, op8_quality_rules, op9_language_id, op10_exact_dedup,
            op11_source_audit, op12_whitening, op13_simhash,
        )
    }


_WS = r"[\x20\x09-\x0D]+"

#: The rules of a line, written out again.
_TERMINAL, _CLOSING = "[.!?…。．！？｡؟۔।॥։።]", "[\"''”’»›)\\]}」』]"
_BAD_LINE = rf"""(NOT ends AND (size <= 200 OR NOT regexp_matches(x, '{_TERMINAL}') OR regexp_matches(x, '\A[\x20\x09-\x0D]*([•‣▪●○◦·–—*-]|[0-9]{{1,3}}[.)])[\x20\x09]')))
        OR (ends AND regexp_matches(x, '(\.\.\.|…){_CLOSING}*[\x20\x09-\x0D]*\z')) OR letters * 2 < size OR symbols * 10 > size OR (items >= 3 AND size <= (items + 1) * 20)
        OR (size <= 200 AND regexp_matches(x, '©|®|™|\([cC]\)[\x20\x09]*[0-9]{{4}}|\A[\x20\x09-\x0D]*(https?://|www\.)[^\x20\x09-\x0D]*[\x20\x09-\x0D]*\z'))"""


def _mixing_sql() -> str:
    """The budgets level by level, then whole epochs and prefixes in the seeded order."""
    weight = lambda v: "CASE " + " ".join(f"WHEN {v.column} = '{k}' THEN {w}" for k, w in v.weights.items()) + f" ELSE {v.default} END" if v.weights else str(v.default)
    ctes, above, parent = [], [], "root"
    for k, v in enumerate(mixing.TREE):
        here = [*above, v.column]
        by = f"PARTITION BY {', '.join(above)}" if above else ""
        join = f"JOIN {parent} USING ({', '.join(above)})" if above else "JOIN root ON true"
        cols = ", ".join(here)
        ctes.append(f"""
        n{k} AS (SELECT {cols}, sum(avail * 2)::HUGEINT AS cap, ({weight(v)})::HUGEINT AS w FROM leaves GROUP BY {cols}),
        o{k} AS (SELECT n{k}.*, budget, budget - coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
                        sum(w) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opn
                 FROM n{k} {join} WINDOW b AS ({by} ORDER BY cap::DOUBLE / w::DOUBLE, {v.column})),
        f{k} AS (SELECT *, cap * opn <= w * lft AS ful FROM o{k}),
        g{k} AS (SELECT *, budget - coalesce(sum(CASE WHEN ful THEN cap END) OVER ({by}), 0) AS rest, sum(CASE WHEN NOT ful THEN w END) OVER ({by}) AS ow FROM f{k}),
        b{k} AS (SELECT {cols}, CASE WHEN ful THEN cap ELSE least((w * rest)::HUGEINT // ow::HUGEINT, cap) END::HUGEINT AS budget FROM g{k})""")
        above, parent = here, f"b{k}"
    cols = ", ".join(above)
    return rf"""
        WITH d AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
                          CASE WHEN regexp_matches(source, '[0-9]$') THEN 'd' || (regexp_extract(source, '([0-9]+)$', 1)::INT % 4) ELSE 'other' END AS domain FROM documents),
        leaves AS (SELECT {cols}, sum(n_tokens)::HUGEINT AS avail FROM d GROUP BY {cols}),
        root AS (SELECT floor(sum(avail)::DOUBLE * 0.8)::HUGEINT AS budget FROM leaves),{",".join(ctes)},
        p AS (SELECT {cols}, (budget // avail)::INT AS whole, (budget % avail)::BIGINT AS part FROM b{len(mixing.TREE) - 1} JOIN leaves USING ({cols}) WHERE avail > 0),
        m AS (SELECT d.*, whole, part, sum(n_tokens) OVER (PARTITION BY {cols} ORDER BY md5('7|' || whole || '|' || doc_id), n_tokens RANGE UNBOUNDED PRECEDING) AS upto FROM d JOIN p USING ({cols}))
        SELECT doc_id, domain, lang, source, unnest(range(whole))::INT AS epoch, n_tokens FROM m
        UNION ALL SELECT doc_id, domain, lang, source, whole, n_tokens FROM m WHERE part > 0 AND upto <= part"""


ORACLE = {
    "op11_source_audit": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        v AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT g.lang, g.source, v.term, v.n AS lang_n, coalesce(k.n, 0)::HUGEINT AS n
              FROM g JOIN v USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) k USING (lang, source, term)),
        p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s)::HUGEINT AS p,
                     1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER s + 5 * count(*) OVER s)::HUGEINT AS q
              FROM c WINDOW s AS (PARTITION BY lang, source)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, rank::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
        WHERE part = 'pair' OR rank <= 50""",
    "op10_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op6_url_filters": r"""
        WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        c AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                                       ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        m AS (SELECT c.page_id, c.host, c.path, h || p AS rule, action FROM c JOIN rules
              ON (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)),
        b AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM m GROUP BY ALL)
        SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.action, 'allow') AS verdict
        FROM c LEFT JOIN b USING (page_id, host, path)""",
    "op3_source_mixing": _mixing_sql(),
    "op8_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        a AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        p AS (SELECT rid, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM a),
        w3 AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS win FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
        rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM w3 WHERE win IS NOT NULL) WHERE c >= 2),
        cov AS (SELECT rid, count(DISTINCT i + k) AS n_rep FROM rep, (VALUES (0), (1), (2)) AS s(k) GROUP BY rid),
        l AS (SELECT rid, x, length(regexp_replace(x, '{_WS}', '', 'g')) AS size, length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) AS letters,
                     length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS symbols,
                     length(x) - length(regexp_replace(x, '[|•·»›→]', '', 'g')) AS items, regexp_matches(x, '{_TERMINAL}{_CLOSING}*[\x20\x09-\x0D]*\z') AS ends
              FROM (SELECT rid, unnest(ls) AS x FROM a)),
        lost AS (SELECT rid, sum(size) AS lost FROM l WHERE {_BAD_LINE} GROUP BY rid),
        m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_WS}', '', 'g'))::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
              FROM a LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed,
               NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND (CASE WHEN word_chars > 0 THEN lost / word_chars::DOUBLE ELSE 0 END) <= 0.5 AS kept
        FROM m""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
