"""Line-first quality rules, as one projection of built-in functions.

Every line with a word is tested on its own: it fails when it has no sentence mark
(punctuation), looks like a menu (navigation), holds a stock phrase of web pages
(boilerplate) or is made of mark-up symbols. Failing lines are removed; a document that
loses more than ``max_loss`` of its line characters is rejected. Repetition inside a text is
measured on hashes of its 5-word windows (64 bits; only two unlike windows with one hash
could be taken for equal).

Scale: no join, no shuffle, no Python; each row's cost is linear in its text but for a sort
of the window hashes of texts that do repeat themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import SPACE, documents, spread

HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SENTENCE = r"[.!?\x{2026}\x{3002}][\"'\x{201D}\x{2019}\x{BB})\]]*([\x20\x09-\x0D]|\z)"
SEPARATOR = r"[|\x{BB}\x{203A}\x{2022}>]"
SEPARATED = r"[|\x{BB}\x{203A}\x{2022}>][\x20\x09-\x0D]"
MENU_ITEM = r"^[\x20\x09-\x0D]*(home|menu|search|login|log in|sign in|sign up|next|previous|back|skip to content)[\x20\x09-\x0D]*\z"
#: Stock phrases of web pages, lower case (fixed values).
STOCK = ("all rights reserved", "cookie policy", "use of cookies", "uses cookies", "accept cookies", "privacy policy",
         "terms of use", "terms of service", "enable javascript", "lorem ipsum", "subscribe to", "click here",
         "read more", "share this", "copyright \u00a9", "powered by")


def let(value, body):
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _windows(h):
    """Hash of each window of five word hashes."""
    return F.when(F.size(h) < 5, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(h, 1, F.greatest(F.size(h) - 4, F.lit(0))),
                    lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 5)])))


def _covered(g):
    """Number of words inside windows that occur twice or more."""
    twice = lambda s: F.filter(s, lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"]))
    same = let(F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))),
               lambda s: F.transform(F.filter(twice(s), lambda x: x["i"].isNotNull()), lambda x: x["i"]))
    step = lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(p, a["end"])).alias("n"))
    return F.aggregate(F.array_sort(same), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"])


def _any(text, phrases):
    out = F.contains(text, F.lit(phrases[0]))
    for p in phrases[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def line_fails(line, marks, menus, stock):
    """Whether a line with a word breaks a rule; ``marks``, ``menus`` and ``stock`` say whether
    its whole text holds a symbol, a separator or a stock phrase at all, so that most texts
    run one pattern a line."""
    low = F.lower(line)
    return (~line.rlike(SENTENCE)
            | (marks & (10 * F.regexp_count(line, F.lit(SYMBOLS)) > F.length(line)))
            | (menus & (F.regexp_count(line, F.lit(SEPARATED)) >= 3))
            | (stock & _any(low, STOCK))
            | ((F.length(line) < 40) & low.rlike(MENU_ITEM)))


def clean_lines(docs: DataFrame, *, text: str = "text", max_loss: float = 0.3) -> DataFrame:
    """All columns of ``docs`` and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_lines_removed, kept, clean_text.

    A null or empty text has no words: counts 0, base_failed, clean_text empty. A column of
    ``docs`` with one of these names is replaced. Repeated rows are judged alike.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.withColumn("__t", t).withColumn("__o", F.lower("__t"))
    docs = docs.withColumns({
        "__w": F.filter(F.split("__t", SPACE), lambda x: x != ""),
        "__l": F.filter(F.split("__t", "\n"), lambda x: x.rlike(HAS_WORD)),
        "__s": F.regexp_count("__t", F.lit(SYMBOLS)),
        "__m": F.col("__t").rlike(SEPARATOR),
        "__b": _any(F.col("__o"), STOCK),
    })
    docs = docs.withColumns({
        "__h": F.transform("__w", lambda x: F.xxhash64(x)),
        "__k": F.filter("__l", lambda x: ~line_fails(x, F.col("__s") > 0, F.col("__m"), F.col("__b"))),
    })
    docs = docs.withColumn("__g", _windows(F.col("__h")))
    chars = lambda a: F.length(F.array_join(a, ""))
    docs = docs.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": chars("__w").cast("long"),
        "n_symbols": F.col("__s").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("__g")) == F.size("__g"), F.lit(0)).otherwise(_covered(F.col("__g"))).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_lines_removed": (F.size("__l") - F.size("__k")).cast("long"),
        "clean_text": F.array_join("__k", "\n"),
        "__all": chars("__l"), "__left": chars("__k"),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    docs = docs.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("__all") - F.col("__left") <= F.lit(max_loss) * F.col("__all"))
    return docs.withColumn("kept", kept).drop("__t", "__o", "__w", "__l", "__s", "__m", "__b", "__h", "__g", "__k", "__all", "__left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: counts and verdict of every document."""
    out = clean_lines(spread(documents(spark, sf_dir).select("doc_id", "text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "n_lines", "n_lines_removed")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, {_q(SPACE)}), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_q(HAS_WORD)})) AS l FROM d),
k AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, {_q(SENTENCE)})
             AND 10 * (length(x) - length(regexp_replace(x, {_q(SYMBOLS)}, '', 'g'))) <= length(x)
             AND len(regexp_extract_all(x, {_q(SEPARATED)})) < 3
             AND NOT ({" OR ".join(f"contains(lower(x), {_q(p)})" for p in STOCK)})
             AND NOT (length(x) < 40 AND regexp_matches(lower(x), {_q(MENU_ITEM)}))) AS k FROM w),
g AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(5) AS o(o) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, {_q(SPACE)}, '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, {_q(SYMBOLS)}, '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             len(l) AS n_lines, len(l) - len(k) AS n_lines_removed,
             coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS total,
             coalesce(list_sum(list_transform(k, lambda x: length(x))), 0) AS rest
      FROM k LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND total - rest <= 0.3 * total AS kept,
       n_lines, n_lines_removed FROM m
"""
