"""Preference formatting of conversations; DataFrame functions only.

A chosen and a rejected conversation that belong together share a number of first turns. The longest common prefix of
turns (same role and same text at the same place) is rendered once as the prompt; the turns after it are each side's
completion. A completion's mask lists the character spans that train the model: the text and end mark of assistant
turns, as [start, stop) offsets into the completion; all other characters are context.

Scale: turns are gathered per conversation (one shuffle by conversation) and the two sides meet on the pair's key (one
shuffle of rendered rows). A conversation is one training example, so it must fit in a row; no other group is ever
gathered: conversations that share first turns, or whole contents, are never compared outside of their pair, so a first
turn that a third of all conversations have costs nothing extra.

Defined results: turns are ordered by (turn, role, text), nulls first, repeated rows stay repeated turns; a null role
renders as the empty role, a null text as the empty text, and nulls equal only nulls in the prefix; a pair with one side only has that side as
completion, an empty prompt, null for the other side and ``complete`` false; null conversation ids are one
conversation whose pair key is null, which pairs with nothing; an empty table gives no rows. Extra columns of the input
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame, key: Column, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: its id, its ordered turns and its pair's key (an expression of ``__id``)."""
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    return (turns.groupBy(F.col(id_col).alias("__id"))
            .agg(F.sort_array(F.collect_list(turn)).alias("__turns"))
            .withColumn("__key", key))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, head_and_body), "")


def head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE))


def body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def head_and_body(t: Column) -> Column:
    return F.concat(head(t), body(t))


def trained_spans(turns: Column) -> Column:
    """[start, stop) offsets, in characters of the rendered turns, of what assistant turns say."""
    def step(acc, t):
        start = acc["at"] + F.length(head(t))
        stop = start + F.length(body(t))
        spans = F.when(t["role"] == TRAINED_ROLE,
                       F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop")))))
        return F.struct(stop.alias("at"), spans.otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,stop:int>>)").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """Number of first turns that are equal in role and text."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"])
                      & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of conversations (frames from ``conversations``) that share a key, formatted.

    Columns: pair_id, chosen_id, rejected_id, complete, prefix_turns, prompt, chosen, rejected (completions),
    chosen_mask, rejected_mask (spans to train on).
    """
    a = chosen.select("__key", F.col("__id").alias("chosen_id"), F.col("__turns").alias("__a"))
    b = rejected.select("__key", F.col("__id").alias("rejected_id"), F.col("__turns").alias("__b"))
    pairs = a.join(b, "__key", "full")
    n = F.coalesce(common_prefix(F.col("__a"), F.col("__b")), F.lit(0))

    def rest(c):
        return F.slice(F.col(c), F.col("prefix_turns") + 1, F.greatest(F.size(c), F.lit(1)))

    return (pairs.withColumn("prefix_turns", n)
            .select(F.col("__key").alias("pair_id"), "chosen_id", "rejected_id",
                    (F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("complete"), "prefix_turns",
                    F.when(F.col("prefix_turns") > 0, rendered(F.slice("__a", F.lit(1), F.col("prefix_turns"))))
                    .otherwise(F.lit("")).alias("prompt"),
                    rest("__a").alias("__a"), rest("__b").alias("__b"))
            .select("pair_id", "chosen_id", "rejected_id", "complete", "prefix_turns", "prompt",
                    rendered(F.col("__a")).alias("chosen"), rendered(F.col("__b")).alias("rejected"),
                    trained_spans(F.col("__a")).alias("chosen_mask"), trained_spans(F.col("__b")).alias("rejected_mask")))


def query(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """All of ``conversations``: the conversation 2j is the chosen, 2j + 1 the rejected side of pair j.

    Masks are given as text ``start-stop,…``, which any engine can compare.
    """
    both = conversations(turns, F.shiftright(F.col("__id").cast("long"), 1))
    even = F.pmod(F.col("__id"), F.lit(2)) == 0
    return masks_as_text(preference_pairs(both.where(even), both.where(~even | even.isNull())))


def query_replaced(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """All of ``conversations``, each as the chosen side of its own pair. The rejected side is the same conversation with its last
    assistant turn's text replaced by that of the neighbour's (2j and 2j + 1 are neighbours; rejected_id is the neighbour), so both share
    the turns before it. Without an assistant turn in both there is no rejected side."""
    both = conversations(turns, F.col("__id"))
    numbered = F.transform("__turns", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i))
    last = both.withColumn("__last", F.array_max(numbered))
    said = last.where(F.col("__last").isNotNull()).select(
        F.col("__id").cast("long").bitwiseXOR(F.lit(1).cast("long")).alias("__key"), F.col("__id").alias("__other"),
        F.get("__turns", F.col("__last"))["text"].alias("__said"))
    rejected = last.where(F.col("__last").isNotNull()).join(said, "__key").select(
        "__key", F.col("__other").alias("__id"),
        F.transform("__turns", lambda t, i: F.struct(t["turn"], t["role"], F.when(i == F.col("__last"), F.col("__said"))
                                                     .otherwise(t["text"]).alias("text"))).alias("__turns"))
    return masks_as_text(preference_pairs(both, rejected))


def masks_as_text(pairs: DataFrame) -> DataFrame:
    def text(mask):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")

    return pairs.withColumns({"chosen_mask": text(F.col("chosen_mask")), "rejected_mask": text(F.col("rejected_mask"))})


SQL = """
WITH turns AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t
  FROM conversations GROUP BY conv_id),
pairs AS (
  SELECT coalesce(a.conv_id // 2, b.conv_id // 2) AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.t AS a, b.t AS b
  FROM (SELECT * FROM turns WHERE conv_id % 2 = 0) a FULL JOIN (SELECT * FROM turns WHERE conv_id % 2 = 1) b
    ON a.conv_id // 2 = b.conv_id // 2),
prefix AS (
  SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce(list_position(
      list_transform(generate_series(1, greatest(len(a), len(b))), lambda i: coalesce(i <= len(a) AND i <= len(b)
        AND a[i].role IS NOT DISTINCT FROM b[i].role AND a[i].text IS NOT DISTINCT FROM b[i].text, false)), false) - 1,
      greatest(len(a), len(b))) END AS n
  FROM pairs),
cut AS (SELECT *, a[n + 1:] AS ra, b[n + 1:] AS rb FROM prefix),
parts AS (
  SELECT *,
    list_transform(a[1:n], lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)) AS p,
    list_transform(ra, lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)) AS pa,
    list_transform(rb, lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)) AS pb
  FROM cut),
masks AS (
  SELECT *,
    list_transform(list_filter(generate_series(1, len(ra)), lambda i: ra[i].role = 'assistant'), lambda i:
      (coalesce(list_sum(list_transform(pa[1:i], lambda s: length(s))), 0)::BIGINT - length(coalesce(ra[i].text, '')) - 8)::VARCHAR
      || '-' || coalesce(list_sum(list_transform(pa[1:i], lambda s: length(s))), 0)::BIGINT::VARCHAR) AS ma,
    list_transform(list_filter(generate_series(1, len(rb)), lambda i: rb[i].role = 'assistant'), lambda i:
      (coalesce(list_sum(list_transform(pb[1:i], lambda s: length(s))), 0)::BIGINT - length(coalesce(rb[i].text, '')) - 8)::VARCHAR
      || '-' || coalesce(list_sum(list_transform(pb[1:i], lambda s: length(s))), 0)::BIGINT::VARCHAR) AS mb
  FROM parts)
SELECT pair_id, chosen_id, rejected_id, (a IS NOT NULL AND b IS NOT NULL) AS complete, n::INTEGER AS prefix_turns,
  coalesce(array_to_string(p, ''), '') AS prompt,
  CASE WHEN a IS NOT NULL THEN coalesce(array_to_string(pa, ''), '') END AS chosen,
  CASE WHEN b IS NOT NULL THEN coalesce(array_to_string(pb, ''), '') END AS rejected,
  CASE WHEN a IS NOT NULL THEN coalesce(array_to_string(ma, ','), '') END AS chosen_mask,
  CASE WHEN b IS NOT NULL THEN coalesce(array_to_string(mb, ','), '') END AS rejected_mask
FROM masks
"""

#: ``SQL`` with the other derivation of the two sides
SQL_REPLACED = SQL[:SQL.index("pairs AS (")] + """last AS (
  SELECT conv_id, t, list_max(list_filter(generate_series(1, len(t)), lambda i: t[i].role = 'assistant')) AS k FROM turns),
pairs AS (
  SELECT c.conv_id AS pair_id, c.conv_id AS chosen_id, o.conv_id AS rejected_id, c.t AS a,
    CASE WHEN o.conv_id IS NOT NULL THEN list_transform(generate_series(1, len(c.t)), lambda i:
      {'turn': c.t[i].turn, 'role': c.t[i].role, 'text': CASE WHEN i = c.k THEN o.t[o.k].text ELSE c.t[i].text END}) END AS b
  FROM last c LEFT JOIN last o ON c.k IS NOT NULL AND o.k IS NOT NULL AND o.conv_id = xor(c.conv_id, 1)),
""" + SQL[SQL.index("prefix AS ("):]
