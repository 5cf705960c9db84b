"""Chat formatting: the turns of a conversation as one text, with Spark expressions only.

The turns are collected as structs and sorted; adjacent ones of a role are merged by array
aggregation over the runs, and the runs concatenated. All steps are linear in the length of the
conversation: runs are found by position, not by growing an array turn by turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

OPEN, CLOSE, JOIN, NO_ROLE = "<|", "<|end|>\n", "\n", "user"


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_messages, text) of turns(conv_id, turn, role, text).

    Turns are sorted by turn, a null one last; ties by role, then text. Repeated rows are repeated
    turns. A conversation is one text, so it must fit a row; markers inside a text stay as they are.
    Defined cases: a null role is "user"; a null or empty text is an empty turn, which still takes
    part; a row with a null conv_id is a conversation of its own, as nothing says which rows belong
    together; an empty table gives no rows; extra columns are ignored.
    """
    t = pick(turns, "conv_id", "turn", "role", "text")
    item = F.struct(
        F.col("turn").isNull().alias("z"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit(NO_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    by = t.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("ts"))
    by = by.unionAll(t.where("conv_id IS NULL").select("conv_id", F.array(item)))
    by = by.withColumn("n", F.size("ts"))
    begins = F.expr("filter(sequence(0, n - 1), i -> i = 0 OR ts[i].role <> ts[i - 1].role)")
    by = by.withColumn("begins", begins)
    run = f"""transform(begins, (b, k) -> concat('{OPEN}', ts[b].role, '|>{JOIN}',
        array_join(transform(slice(ts, b + 1, coalesce(get(begins, k + 1), n) - b), t -> t.text), '{JOIN}'), '{CLOSE}'))"""
    return by.select("conv_id", F.col("n").cast("long").alias("n_turns"), F.size("begins").cast("long").alias("n_messages"), F.array_join(F.expr(run), "").alias("text"))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '{NO_ROLE}') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
g AS (SELECT *, sum(CASE WHEN before = role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM o),
m AS (SELECT conv_id, run, any_value(role) AS role, count(*) AS n, string_agg(text, '{JOIN}' ORDER BY i) AS text FROM g GROUP BY conv_id, run)
SELECT conv_id, sum(n)::BIGINT AS n_turns, count(*) AS n_messages,
       string_agg('{OPEN}' || role || '|>{JOIN}' || text || '{CLOSE}', '' ORDER BY run) AS text FROM m GROUP BY conv_id
UNION ALL SELECT conv_id, 1, 1, '{OPEN}' || coalesce(role, '{NO_ROLE}') || '|>{JOIN}' || coalesce(text, '') || '{CLOSE}' FROM conversations WHERE conv_id IS NULL
"""
