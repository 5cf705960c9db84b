"""Mixing sources to target weights.

The tokens of each source are summed, the target weights turned into repetition rates, and each
document comes out floor(rate) times, plus once more if a draw seeded by its id falls under the
fraction of the rate. So the expected tokens of a source are exactly its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKEN, cut, flat, n_tokens, small

SEED = "mix-1"
#: Target weights: relative shares of the tokens by source, and that of each source not named.
WEIGHTS: dict[str | None, float] = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
REST = 1.0


def draw(key, seed: str):
    """A number in [0, 1) that depends on seed and key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = WEIGHTS, rest: float = REST, tokens: float | None = None) -> DataFrame:
    """(source, tokens, rate) of docs(source, n_tokens).

    weights: share of each source, which need not add up to 1; sources that it leaves out get rest.
    tokens: how many to emit in all; None: as many as there are.
    """
    by = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in (weights or {}).items()], "of string, w double")
    by = by.join(F.broadcast(given), F.col("source").cast("string").eqNullSafe(F.col("of")), "left").withColumn("w", F.coalesce("w", F.lit(float(rest))))
    by = by.withColumn("live", F.when(F.col("tokens") > 0, F.col("w")).otherwise(0.0))
    total = by.agg(F.sum("live").alias("all_w"), F.sum("tokens").alias("all_tokens"))
    want = F.col("all_tokens").cast("double") if tokens is None else F.lit(float(tokens))
    rate = (
        F.when((F.col("tokens") > 0) & (F.col("w") > 0), F.col("w") / F.col("all_w") * want / F.col("tokens"))
        .when(F.col("w") > 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return by.crossJoin(total).select("source", "tokens", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = WEIGHTS, rest: float = REST, tokens: float | None = None, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(docs repeated, with positional columns and n_tokens, rate, copy; the rates).

    Defined cases: a null source is a source of its own (weight key None); a null or empty text has
    no tokens; a source without tokens can't reach a share, takes part in none, and comes out once
    if its weight is over 0; a null doc_id draws by its text; repeated rows draw alike, each for
    itself; an empty table gives an empty result; extra columns are carried along.
    """
    out, where, _ = flat(docs)
    out = out.withColumn("n_tokens", n_tokens(F.col(where["text"])))
    own = cut(rates(out.select(F.col(where["source"]).alias("source"), "n_tokens"), weights, rest, tokens))
    r = own.select(F.col("source").alias("mix_source"), "rate")
    joined = out.join(small(r), F.col(where["source"]).eqNullSafe(F.col("mix_source")))
    key = F.coalesce(F.col(where["doc_id"]).cast("string"), F.col(where["text"]), F.lit(""))
    whole = F.floor("rate")
    copies = (whole + F.when(draw(key, seed) < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    joined = joined.withColumn("copies", copies).where("copies > 0")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))), own


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = WEIGHTS, rest: float = REST, tokens: float | None = None, seed: str = SEED) -> DataFrame:
    """The mixed documents, with the columns of docs."""
    out, _ = mix(docs, weights, rest, tokens, seed)
    return out.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def emitted(docs: DataFrame, weights: dict[str | None, float] | None = WEIGHTS, rest: float = REST, tokens: float | None = None, seed: str = SEED) -> DataFrame:
    """A row for each copy that comes out: doc_id, source, n_tokens, rate, copy."""
    _, where, _ = flat(docs)
    out, _ = mix(docs, weights, rest, tokens, seed)
    return out.select(F.col(where["doc_id"]).alias("doc_id"), F.col(where["source"]).alias("source"), "n_tokens", "rate", "copy")


_GIVEN = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items())
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0)::INT AS n_tokens, coalesce(doc_id::VARCHAR, text, '') AS key FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, CASE source {_GIVEN} ELSE {REST}::DOUBLE END AS w FROM d GROUP BY source),
a AS (SELECT sum(CASE WHEN tokens > 0 THEN w ELSE 0.0::DOUBLE END) AS all_w, sum(tokens)::DOUBLE AS all_tokens FROM s),
r AS (SELECT source, CASE WHEN tokens > 0 THEN w / all_w * all_tokens / tokens ELSE 1.0::DOUBLE END AS rate FROM s, a),
c AS (SELECT d.*, rate, (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, n_tokens, rate, unnest(range(copies))::INT AS copy FROM c WHERE copies > 0
"""
