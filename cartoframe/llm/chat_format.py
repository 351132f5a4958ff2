"""Preference formatting of paired conversations.

The longest common turn prefix of the chosen and the rejected conversation is
rendered once, as the prompt; what follows is rendered as two completions, each
with a mask of the spans that are trained on: the contents (with the end mark) of
turns by the assistant.  Spans are character offsets [start, end) in the
completion.

Turns are brought together by one shuffle on the pair.  Where each turn begins in
its conversation is a running sum over rows, so the work is linear in the turns.
Only DataFrame functions are used.

Defined cases: a side without turns has an empty conversation (no common prefix,
an empty completion).  Turns are ordered by turn, role, text, nulls first; two
turns are equal if role and text are, nulls included; repeated rows are turns of
their own.  Null roles render as `unknown`, null texts as empty.  Texts are
rendered whole, however long; a pair is one row, so its two conversations must fit
in a value of 2 GB.  Rows without pair or side are left out: they belong to no
conversation.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def _role(t: Column) -> Column:
    return F.coalesce(t["role"], F.lit("unknown"))


def _text(t: Column) -> Column:
    return F.coalesce(t["text"], F.lit(""))


def _rendered(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _role(t), F.lit("\n"), _text(t), F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column, prompt: Column) -> Column:
    """Spans of the trained contents, counted from the end of the prompt."""
    own = F.filter(turns, lambda t: t["role"] == TRAINED)
    return F.transform(own, lambda t: F.struct(
        (t["begin"] - F.length(prompt) + len(OPEN) + 1 + F.length(_role(t))).cast("long").alias("start"), (t["begin"] - F.length(prompt) + F.length(_rendered(t)) - 1).cast("long").alias("end")))


def preference_pairs(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "chosen", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_id, n_shared, prompt, chosen, rejected, chosen_mask, rejected_mask from turns with a pair and a side (true: chosen)."""
    t = F.struct(F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = turns.where(F.col(pair_col).isNotNull() & F.col(side_col).isNotNull()).select(F.col(pair_col).alias("pair_id"), F.col(side_col).cast("boolean").alias("side"), F.col(turn_col).cast("long").alias("turn"), t.alias("t"))
    order = Window.partitionBy("pair_id", "side").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("t.role"), F.asc_nulls_first("t.text"))
    rows = rows.withColumn("n", F.length(_rendered(F.col("t"))).cast("long")).repartition("pair_id")
    rows = rows.select("pair_id", "side", F.struct(F.row_number().over(order).alias("pos"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("begin"), "t.role", "t.text").alias("t"))
    side = lambda own: F.array_sort(F.collect_list(F.when(own, F.col("t"))))
    grouped = rows.groupBy("pair_id").agg(side(F.col("side")).alias("c"), side(~F.col("side")).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]) & a.isNotNull() & b.isNotNull())
    shared = F.coalesce(F.array_position(same, False) - 1, F.lit(-1))
    shared = F.when(shared < 0, F.size(same)).otherwise(shared).cast("int")
    grouped = grouped.withColumn("n_shared", shared)
    rest = lambda c: F.slice(c, F.col("n_shared") + 1, F.size(c))
    grouped = grouped.select("pair_id", "n_shared", _render(F.slice("c", F.lit(1), F.col("n_shared"))).alias("prompt"), rest("c").alias("c"), rest("r").alias("r"))
    return grouped.select("pair_id", F.col("n_shared").cast("long").alias("n_shared"), "prompt", _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _mask(F.col("c"), F.col("prompt")).alias("chosen_mask"), _mask(F.col("r"), F.col("prompt")).alias("rejected_mask"))


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Neighbouring conversations as preference pairs: an even conv_id is chosen over the odd one after it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = preference_pairs(turns.select(F.expr("conv_id div 2").alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"), "turn", "role", "text"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return pairs.select("pair_id", "n_shared", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


def sql() -> str:
    one = lambda c: f"'{OPEN}' || {c}.role || chr(10) || {c}.text || '{CLOSE.strip()}' || chr(10)"
    return f"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, role AS r0, text AS t0, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL
), m AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos, c.pos IS NOT NULL AND r.pos IS NOT NULL AND c.r0 IS NOT DISTINCT FROM r.r0 AND c.t0 IS NOT DISTINCT FROM r.t0 AS same
  FROM (FROM t WHERE chosen) c FULL JOIN (FROM t WHERE NOT chosen) r ON c.pair_id = r.pair_id AND c.pos = r.pos
), s AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT same), max(pos) + 1) - 1 AS n_shared FROM m GROUP BY pair_id
), k AS (SELECT t.*, n_shared, {one('t')} AS line FROM t JOIN s USING (pair_id)
), e AS (SELECT *, sum(length(line)) OVER (PARTITION BY pair_id, chosen ORDER BY pos) - length(line) AS begun FROM k WHERE pos > n_shared
), x AS (SELECT pair_id, chosen, pos, line, CASE WHEN role = '{TRAINED}' THEN CAST(begun + {len(OPEN) + 1} + length(role) AS BIGINT) || '-' || CAST(begun + length(line) - 1 AS BIGINT) END AS span FROM e)
SELECT s.pair_id, n_shared,
  coalesce((SELECT string_agg(line, '' ORDER BY pos) FROM k WHERE k.pair_id = s.pair_id AND chosen AND pos <= k.n_shared), '') AS prompt,
  coalesce((SELECT string_agg(line, '' ORDER BY pos) FROM x WHERE x.pair_id = s.pair_id AND chosen), '') AS chosen,
  coalesce((SELECT string_agg(line, '' ORDER BY pos) FROM x WHERE x.pair_id = s.pair_id AND NOT chosen), '') AS rejected,
  coalesce((SELECT string_agg(span, ',' ORDER BY pos) FROM x WHERE x.pair_id = s.pair_id AND chosen), '') AS chosen_mask,
  coalesce((SELECT string_agg(span, ',' ORDER BY pos) FROM x WHERE x.pair_id = s.pair_id AND NOT chosen), '') AS rejected_mask
FROM s"""
