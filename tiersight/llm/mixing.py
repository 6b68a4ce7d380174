"""Mixing sources to target weights by Poisson replication.

Each document is repeated as often as a Poisson variable with its source's mean repetition rate
says; the variable is inverted from a hash of the document's id, so a rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersight.llm.flat import free_name
from tiersight.operators.staging import stage

#: Means above this are drawn as a sum of equal parts, so that exp(-mean) stays a normal number.
PART = 256.0
DIGITS = 13


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the MD5 of the key's parts joined by `:`."""
    digits = F.substring(F.md5(F.concat_ws(":", *key).cast("binary")), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(16**DIGITS)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far into the upper tail."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        total = acc["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), F.concat(acc["out"], F.array(total)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["out"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """(source, size, rate): the mean number of times that each document of a source is taken.

    size: characters of all the source's texts. The mix holds `epochs` times the characters of all
    sources, dealt to sources by `weights` (a source that it lacks gets none) or, without them, in
    proportion to size to the power `power`. Null is a source like any other. A source without
    characters keeps each of its documents `epochs` times in the mean.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(power))
    else:
        share = F.lit(0.0)
        for source, weight in weights.items():
            share = F.when(F.col("source") == source, F.lit(float(weight))).otherwise(share)
    sized = stage(sizes.select("source", "size", share.alias("share")))
    total = sized.agg(F.sum("size").alias("total"), F.sum(F.when(F.col("size") > 0, F.col("share"))).alias("shares"))
    rate = F.when(F.col("size") > 0, F.col("share") / F.col("shares") * F.col("total") / F.col("size") * epochs)
    return sized.join(F.broadcast(total)).select("source", "size", F.coalesce(rate, F.lit(float(epochs))).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """All columns of `docs`, copy (from 0) and shuffle_key, one row per copy, in random order.

    Rows of one doc_id get the same count, so repeated rows stay alike; a null doc_id counts as the
    id `null`. Null texts have no characters and are repeated like the rest of their source. An
    empty table gives an empty table. Columns of `docs` named copy or shuffle_key are replaced.
    """
    taken = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    return _mixed(docs.select(*taken), "copy", "shuffle_key", weights, power, epochs, seed)


def mixed_rows(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """The rows of `docs` as often as `mix` takes them, in random order, with their own columns only."""
    return _mixed(docs, free_name("_copy", docs), free_name("_key", docs), weights, power, epochs, seed).select(*docs.columns)


def _mixed(docs: DataFrame, copy: str, key: str, weights: dict[str, float] | None, power: float, epochs: float, seed: int) -> DataFrame:
    source, cdf, number, count = (free_name(n, docs) for n in ("_source", "_cdf", "_parts", "_count"))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    rates = source_rates(docs, weights, power, epochs).select(F.col("source").alias(source), parts.alias(number), (F.col("rate") / parts).alias("mean"))
    table = stage(rates.select(source, number, poisson_cdf(F.col("mean")).alias(cdf)))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    part = lambda i: uniform(F.lit(str(seed)), i.cast("string"), doc)
    # the number of k with P(X <= k) <= u; the table is sorted
    below = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
    drawn = F.aggregate(F.sequence(F.lit(0), F.col(number) - 1), F.lit(0), lambda n, i: n + below(part(i)))
    taken = docs.join(table, F.col("source").eqNullSafe(F.col(source))).withColumn(count, drawn).where(F.col(count) > 0)
    copies = taken.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(copy))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), doc, F.col(copy).cast("string")).cast("binary"))
    return copies.withColumn(key, order).repartition(key).sortWithinPartitions(key)


MIX_SQL = """
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source
), shares AS (
  SELECT source, size, pow(size::DOUBLE, 0.7) AS share FROM sizes
), totals AS (
  SELECT sum(size)::DOUBLE AS total, sum(CASE WHEN size > 0 THEN share END) AS shares FROM shares
), rates AS (
  SELECT source, coalesce(CASE WHEN size > 0 THEN share / shares * total / size END, 1.0) AS rate FROM shares, totals
), steps AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, range(0, 120) AS t(k)
), drawn AS (
  SELECT doc_id, source, ('0x' || substr(md5('42:0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents
), counts AS (
  SELECT d.doc_id, count(*) AS n FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.cdf <= d.u
  GROUP BY d.doc_id
)
SELECT d.*, c.copy::INTEGER AS copy, md5('42-order:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || c.copy::VARCHAR) AS shuffle_key
FROM documents d
JOIN (SELECT doc_id, unnest(range(0, n)) AS copy FROM counts) c ON c.doc_id = d.doc_id
"""
