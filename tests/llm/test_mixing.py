import hashlib
import math

from pyspark.sql import functions as F

from tiersight.llm import mixing, queries


def plain_copies(rows, power=0.7, seed=42):
    """doc_id to number of copies."""
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text or "")
    shares = sum(n**power for n in sizes.values() if n)
    rates = {s: n**power / shares * sum(sizes.values()) / n if n else 1.0 for s, n in sizes.items()}
    out = {}
    for r in rows:
        name = "null" if r.doc_id is None else str(r.doc_id)
        u = int(hashlib.md5(f"{seed}:0:{name}".encode()).hexdigest()[:13], 16) / 16**13
        mean, k = rates[r.source], 0
        p = total = math.exp(-mean)
        while total <= u:
            k += 1
            p *= mean / k
            total += p
        out[r.doc_id] = k
    return out


def test_counts_of_a_whole_table(spark, sf):
    docs = queries.table(spark, sf, "documents")
    want = plain_copies(docs.collect())
    got = queries.op3_source_mixing(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m")).collect()
    assert {r.doc_id: r.n for r in got} == {i: n for i, n in want.items() if n}
    assert all(r.n == r.d == r.m + 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, "abc", None, 1), (1, "abc", None, 1), (None, None, "a", 2), (2, "", "b", 3), (3, "x" * 100_000, "c", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    counts = {}
    for r in got.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    want = plain_copies(docs.collect())
    assert counts == {i: n * (2 if i == 1 else 1) for i, n in want.items() if n}
    assert mixing.mix(docs.where("false")).count() == 0
    same = mixing.mixed_rows(docs)
    assert same.columns == docs.columns and {r.copy for r in same.collect()} <= {1, 2, 3, 4} and same.count() == sum(counts.values())


def test_weights_and_large_means(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.when(F.col("id") < 4, "rare").otherwise("rest").alias("source"))
    got = {r.source: r.n for r in mixing.mix(docs, weights={"rare": 3.0, "rest": 1.0}, epochs=4.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    # 1200 rows of rare in the mean, 300 a document; 400 of the rest
    assert abs(got["rare"] - 1200) < 5 * 1200**0.5 and abs(got["rest"] - 400) < 5 * 400**0.5


def test_distribution(spark):
    """Counts follow the distribution, also where a mean is drawn in parts."""
    for mean in (0.5, 3.0, 600.0):
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
        n = mixing.mix(docs, epochs=mean).groupBy("doc_id").count().agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
        average = n[0] / 3000
        assert abs(average - mean) < 5 * (mean / 3000) ** 0.5
        assert abs(n[1] / 3000 - average**2 - mean) < 0.2 * mean
