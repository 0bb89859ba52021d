"""Rule-based document quality: a threshold table compiled into Spark projections, without user functions.

Measures are counted with built-in array functions inside the row. Words are the maximal runs of characters other than
space and \\x09-\\x0D. Repeated words: every 8-word window is hashed to 64 bits; only if a document has fewer distinct
windows than windows are (hash, position) pairs sorted, windows with an equal neighbour kept, and the words they cover
counted by the gaps between their positions. All steps take at most n log n time in a text of n words and no row meets
another, so the plan has no shuffle and no group to be skewed.

Defined results: null texts count as texts without words; documents that fail the base rules are not kept; repeated
rows are judged each on its own; an empty table gives no rows; columns of the input with the names of results are not
read. Ratios are compared in whole numbers (100 · count against percent · total), so limits are met exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "on", "are", "this", "by",
    "der", "die", "und", "das", "von", "den", "mit", "zu", "ist", "auf", "für", "im", "dem", "nicht", "ein", "eine",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "est", "que", "pour", "dans", "qui", "par", "sur", "pas",
    "el", "los", "las", "y", "en", "del", "por", "con", "una", "se", "no", "es", "lo", "su", "al",
)


@dataclass(frozen=True)
class Rule:
    """``low`` ≤ 100 · ``count`` / ``total`` ≤ ``high`` (percent; either may be None); ``total`` "1" compares counts."""

    count: str
    total: str
    low: int | None = None
    high: int | None = None


#: The table. A document that passes the base rules is kept if it passes all of these.
RULES = (
    Rule("word_chars", "n_words", low=200, high=1500),      # mean word length
    Rule("n_symbols", "n_words", high=10),
    Rule("n_stop_words", "n_words", low=2),
    Rule("n_dup_lines", "n_lines", high=35),
    Rule("n_bullet_lines", "n_lines", high=90),
    Rule("n_ellipsis_lines", "n_lines", high=30),
)


def measures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """id_col and all counts of the rules. Each projection uses the arrays of the one before more than once, so that
    Spark keeps them apart and makes every array once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.col(id_col), text.alias("__text")).select(
        id_col, "__text", F.array_remove(F.split("__text", SPACE), "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    n = F.size("__words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
                                              lambda i: F.xxhash64(F.slice("__words", i, F.lit(WINDOW)))))
    stop = F.filter("__words", lambda w: F.lower(w).isin(*stop_words))
    counted = split.select(
        id_col, n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("__lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(stop).cast("long").alias("n_stop_words"),
        F.coalesce(windows, F.expr("CAST(array() AS array<bigint>)")).alias("__h"))
    keep = [c for c in counted.columns if not c.startswith("__")]
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = counted.select(*keep, F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs).alias("__s"))
    twice = F.filter("__s", lambda e, j: (F.get("__s", j - 1)["h"] == e["h"]).eqNullSafe(F.lit(True))
                     | (F.get("__s", j + 1)["h"] == e["h"]).eqNullSafe(F.lit(True)))
    found = ordered.select(*keep, F.sort_array(F.transform(twice, lambda e: e["i"])).alias("__p"))
    covered = F.transform("__p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", j + 1) - p, F.lit(WINDOW))))
    repeated = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return found.select(*keep, F.coalesce(repeated, F.lit(0).cast("long")).alias("n_repeat_words"))


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The table as one expression."""
    ok = F.lit(True)
    for r in rules:
        total = F.lit(100) if r.total == "1" else F.col(r.total)
        if r.low is not None:
            ok = ok & (100 * F.col(r.count) >= r.low * total)
        if r.high is not None:
            ok = ok & (100 * F.col(r.count) <= r.high * total)
    return ok


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, the counts, base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (measures(docs, text_col, id_col).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return judge(docs)


def _rule_sql(r: Rule) -> str:
    total = "100" if r.total == "1" else r.total
    return " AND ".join([f"100 * {r.count} >= {r.low} * {total}"] * (r.low is not None)
                        + [f"100 * {r.count} <= {r.high} * {total}"] * (r.high is not None))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
pos AS (SELECT doc_id, unnest(generate_series(1, len(words) - 7)) AS i, words FROM w WHERE len(words) >= 8),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS x FROM pos),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
r AS (SELECT doc_id, sum(g)::BIGINT AS n FROM (
        SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ellipsis_lines,
    len(list_filter(words, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND {' AND '.join(_rule_sql(r) for r in RULES)}) AS kept FROM b
"""
