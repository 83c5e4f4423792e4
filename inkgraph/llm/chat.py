"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A turn is rendered as OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turn() -> Column:
    return F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _in_order(turns: Column) -> Column:
    return F.transform(F.array_sort(turns), lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))


def conversations_as_arrays(turns: DataFrame, name: str = "turns") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, ties by role and text; null role and text count as empty.

    A conversation is one row, as its rendering is. Turns without a conv_id belong to no conversation.
    """
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(_in_order(F.collect_list(_turn())).alias(name))


def common_turns(left: Column, right: Column) -> Column:
    """The number of leading turns in which role and text agree."""
    most = F.least(F.size(left), F.size(right))
    same = F.transform(F.slice(left, 1, most), lambda t, k: t == F.get(right, k))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(most).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE), t.text, F.lit(CLOSE))), "")


def trained_spans(turns: Column, role: str = "assistant") -> Column:
    """[start, end) in characters of what is learnt from: text and end mark of the turns of that role."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        first = acc.at + F.length(t.role) + len(OPEN) + len(MIDDLE)
        last = first + F.length(t.text) + len(CLOSE)
        spans = F.when(t.role == role, F.concat(acc.spans, F.array(F.struct(first.alias("start"), last.alias("end"))))).otherwise(acc.spans)
        return F.struct(last.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc.spans)


def _rest(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def format_preferences(pairs: DataFrame, keys: list[str], chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """keys, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans for rows with two arrays of turns.

    The longest common turn prefix is rendered once, as the prompt; what is left of either conversation
    is its completion, and its spans tell where the loss counts. Where one conversation begins the
    other, or both are equal, a completion is empty and has no spans. Rows are kept one to one, repeats
    and null keys too; a null array counts as no turns. Other columns are not read.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    base = pairs.select(*keys, F.coalesce(F.col(chosen), empty).alias("_a"), F.coalesce(F.col(rejected), empty).alias("_b"))
    base = base.withColumn("_n", common_turns(F.col("_a"), F.col("_b")))
    base = base.select(*keys, F.col("_n").alias("n_prompt_turns"), rendered(F.slice("_a", 1, F.col("_n"))).alias("prompt"), _rest(F.col("_a"), F.col("_n")).alias("_a"), _rest(F.col("_b"), F.col("_n")).alias("_b"))
    return base.select(*keys, "n_prompt_turns", "prompt", rendered(F.col("_a")).alias("chosen"), rendered(F.col("_b")).alias("rejected"), trained_spans(F.col("_a")).alias("chosen_spans"), trained_spans(F.col("_b")).alias("rejected_spans"))


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Pairs (conv_id, chosen, rejected): a conversation, and itself with its last answer taken from its neighbour.

    Neighbours are the ids 2k and 2k + 1, which one shuffle brings together. A conversation is paired
    if both have an assistant turn; turns without a conv_id are in no pair.
    """
    def half(k: int) -> Column:
        return _in_order(F.collect_list(F.when(F.col("_half") == k, _turn())))

    def answer(side: Column) -> Column:  # the place of the last one
        return F.array_max(F.filter(F.transform(side, lambda t, k: F.when(t.role == "assistant", k)), lambda k: k.isNotNull()))

    known = turns.where("conv_id IS NOT NULL").withColumn("_pair", F.shiftright(F.col("conv_id").cast("long"), 1)).withColumn("_half", F.col("conv_id").cast("long").bitwiseAND(F.lit(1).cast("long")))
    pairs = known.groupBy("_pair").agg(F.min(F.when(F.col("_half") == 0, F.col("conv_id"))).alias("_id0"), F.min(F.when(F.col("_half") == 1, F.col("conv_id"))).alias("_id1"), half(0).alias("_t0"), half(1).alias("_t1"))
    pairs = pairs.select("*", answer(F.col("_t0")).alias("_a0"), answer(F.col("_t1")).alias("_a1")).where("_a0 IS NOT NULL AND _a1 IS NOT NULL")

    def side(k: int) -> Column:
        return F.struct(F.col(f"_id{k}").alias("conv_id"), F.col(f"_t{k}").alias("chosen"), F.col(f"_a{k}").alias("_place"), F.get(f"_t{1 - k}", F.col(f"_a{1 - k}")).alias("_other"))

    both = pairs.select(F.explode(F.array(side(0), side(1))).alias("_side")).select("_side.*")
    return both.select("conv_id", "chosen", F.transform("chosen", lambda t, k: F.when(k == F.col("_place"), F.col("_other")).otherwise(t)).alias("rejected"))


def spans_as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string"))), ",")


SWAPPED_SQL = """
WITH t AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), a AS (
    SELECT *, len(turns) - list_position(list_reverse(list_transform(turns, lambda x: x.role = 'assistant')), true) + 1 AS place
    FROM t WHERE list_contains(list_transform(turns, lambda x: x.role), 'assistant')
), p AS (
    SELECT a.conv_id, a.turns AS c, list_transform(a.turns, lambda x, i: CASE WHEN i = a.place THEN b.turns[b.place] ELSE x END) AS r
    FROM a JOIN a b ON b.conv_id = xor(a.conv_id, 1)
), n AS (
    SELECT *, coalesce(list_position(list_transform(c, lambda x, i: x = r[i]), false) - 1, len(c)) AS n_prompt_turns FROM p
), k AS (
    SELECT conv_id, n_prompt_turns, c[1:n_prompt_turns] AS m, c[n_prompt_turns + 1:] AS c, r[n_prompt_turns + 1:] AS r FROM n
), x AS (
    SELECT *, list_transform(m, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS ms,
        list_transform(c, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS cs,
        list_transform(r, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS rs FROM k
)
SELECT conv_id, CAST(n_prompt_turns AS INTEGER) AS n_prompt_turns, coalesce(array_to_string(ms, ''), '') AS prompt,
    coalesce(array_to_string(cs, ''), '') AS chosen, coalesce(array_to_string(rs, ''), '') AS rejected,
    coalesce(array_to_string(list_filter(list_transform(c, lambda x, i: CASE WHEN x.role = 'assistant' THEN CAST(coalesce(list_sum(list_transform(cs[1:i - 1], lambda y: length(y))), 0) + length(x.role) + 5 AS BIGINT)::VARCHAR || '-' || CAST(coalesce(list_sum(list_transform(cs[1:i], lambda y: length(y))), 0) AS BIGINT)::VARCHAR END), lambda z: z IS NOT NULL), ','), '') AS chosen_spans,
    coalesce(array_to_string(list_filter(list_transform(r, lambda x, i: CASE WHEN x.role = 'assistant' THEN CAST(coalesce(list_sum(list_transform(rs[1:i - 1], lambda y: length(y))), 0) + length(x.role) + 5 AS BIGINT)::VARCHAR || '-' || CAST(coalesce(list_sum(list_transform(rs[1:i], lambda y: length(y))), 0) AS BIGINT)::VARCHAR END), lambda z: z IS NOT NULL), ','), '') AS rejected_spans
FROM x"""
