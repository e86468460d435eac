"""Line-first quality rules, with DataFrame functions only.

Each line is judged by itself, by its shape (punctuation, navigation, boilerplate); lines that fail are taken out, and a document that
loses too much of its text that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
#: Marks that end a sentence, in several scripts, and marks that may follow them.
TERMINAL, CLOSING = ".!?\u2026\u3002\uff0e\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965\u0589\u1362", "\"'\u201d\u2019\u00bb\u203a)\\]}\u300d\u300f"
_SPACES = r"[\x20\x09-\x0D]*"
#: A line's end after a sentence; an end that was cut off; a bullet or number at the start; a mark between items of a
#: navigation bar; a notice of rights, or nothing but a link. No rule knows words, so all hold for any language.
ENDS = f"[{TERMINAL}][{CLOSING}]*{_SPACES}\\z"
CUT = f"(?:\\.\\.\\.|\u2026)[{CLOSING}]*{_SPACES}\\z"
BULLET = f"\\A{_SPACES}(?:[\u2022\u2023\u25aa\u25cf\u25cb\u25e6\u00b7\u2013\u2014*-]|[0-9]{{1,3}}[.)])[\\x20\\x09]"
ITEM = "[|\u2022\u00b7\u00bb\u203a\u2192]"
NOTICE = f"\u00a9|\u00ae|\u2122|\\([cC]\\)[\\x20\\x09]*[0-9]{{4}}|\\A{_SPACES}(?:https?://|www\\.)[^\\x20\\x09-\\x0D]*{_SPACES}\\z"
#: Code points of a line up to which it may be a notice, and beyond which a sentence inside does for its end; items of a
#: navigation bar at least, and code points an item at most.
SHORT, ITEMS, ITEM_SIZE = 200, 3, 20


#: Repeated windows of a text up to which its windows are looked up one by one; beyond, all are sorted.
FEW = 64


def line_facts(text: Column) -> Column:
    """For each line (split at newlines) with a word: the line, its code points outside white space, letters, symbols,
    item marks, and whether it ends as a sentence does.

    A lambda's common parts aren't shared by Spark, so each fact is computed once here and only read later.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(
        lines,
        lambda x: F.struct(
            x.alias("line"),
            F.length(F.regexp_replace(x, common.SPACE, "")).alias("size"),
            F.length(F.regexp_replace(x, r"[^\p{L}]+", "")).alias("letters"),
            (F.length(x) - F.length(F.regexp_replace(x, f"[{SYMBOLS}]+", ""))).alias("symbols"),
            (F.length(x) - F.length(F.regexp_replace(x, ITEM, ""))).alias("items"),
            x.rlike(ENDS).alias("ends"),
        ),
    )


def bad_line(x: Column) -> Column:
    """A line fails by punctuation (it doesn't end as a sentence does, or was cut off, or is a bullet without an end; a
    long one may have its sentences inside), by too few letters or too many symbols, as navigation (items between marks),
    or as boilerplate (a notice of rights, a bare link)."""
    line, size = x["line"], x["size"]
    punctuation = (~x["ends"] & ((size <= SHORT) | ~line.rlike(f"[{TERMINAL}]") | line.rlike(BULLET))) | (x["ends"] & line.rlike(CUT))
    navigation = (x["items"] >= ITEMS) & (size <= (x["items"] + 1) * ITEM_SIZE)
    return punctuation | (x["letters"] * 2 < size) | (x["symbols"] * 10 > size) | navigation | ((size <= SHORT) & line.rlike(NOTICE))


def _total(lines: str | Column, name: str) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda total, x: total + x[name])


def quality_rules(docs: DataFrame, max_lost: float = 0.5, min_words: int = 50, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keep``, the base metrics, base_failed, lost_share, cleaned (the text without failed lines) and kept.

    base_failed: fewer than ``min_words`` words, or over half of them in repeated three-word windows. lost_share: of the
    characters outside white space, how many stood in lines that failed (0 for a text without words). kept: not
    base_failed, and lost_share at most ``max_lost``. Null and empty texts have no words and aren't kept. Repeated rows
    stay apart; only ``keep`` and the text are read, so other columns can't clash.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumns({"_words": F.filter(F.split("_text", common.SPACE), lambda w: w != ""), "_lines": line_facts(F.col("_text"))})
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": _total("_lines", "size"),
            "n_symbols": _total("_lines", "symbols"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct(F.col("_lines.line")))).cast("long"),
            "_bad": F.filter("_lines", bad_line),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    # words in three-word windows that occur again: most texts have no window twice, which a set of hashes shows
    n, h, w = F.size("_words"), F.col("_hashes"), F.col("_words")
    rows = rows.withColumn("_windows", F.when(n >= 4, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(h, i), F.element_at(h, i + 1), F.element_at(h, i + 2)))))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array("_windows")))
    rows = rows.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, i: (i > 0) & (x == F.element_at(F.col("_sorted"), F.greatest(i, F.lit(1)))))))
    every = F.transform("_windows", lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i")))
    rows = rows.withColumn("_again", F.when(F.size("_twice") > FEW, F.array_sort(every)).when(F.size("_twice") > 0, F.array_sort(F.filter(every, lambda x: F.array_contains(F.col("_twice"), x["h"])))))
    # neighbours in the order of hashes are repeats if their words are the same
    same = lambda a, b: (a["h"] == b["h"]) & (F.element_at(w, a["i"]) == F.element_at(w, b["i"])) & (F.element_at(w, a["i"] + 1) == F.element_at(w, b["i"] + 1)) & (F.element_at(w, a["i"] + 2) == F.element_at(w, b["i"] + 2))
    at = lambda i: F.element_at(F.col("_again"), i)
    repeats = F.filter("_again", lambda x, i: ((i > 0) & same(x, at(F.greatest(i, F.lit(1))))) | ((i + 1 < F.size("_again")) & same(x, at(F.least(i + 2, F.size("_again"))))))
    rows = rows.withColumn("_starts", F.transform(repeats, lambda x: x["i"]))
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.array(i, i + 1, i + 2))))
    rows = rows.withColumns(
        {
            "n_repeat_words": F.when(F.size("_starts") > 0, F.size(covered)).otherwise(0).cast("long"),
            "lost_share": F.when(F.col("word_chars") > 0, _total("_bad", "size") / F.col("word_chars")).otherwise(F.lit(0.0)),
        }
    )
    rows = rows.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share",
        F.array_join(F.transform(F.filter("_lines", lambda x: ~bad_line(x)), lambda x: x["line"]), "\n").alias("cleaned"),
        (~F.col("base_failed") & (F.col("lost_share") <= max_lost)).alias("kept"),
    )
