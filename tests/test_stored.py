import re

from pyspark.sql import functions as F

from tiersight.operators import stored, textsearch

SCHEMA = "entry int, level_rank int, name string, arabic string, slug string"


def units(spark):
    rows = [(1, 1, "Tanger", "طنجة", "tanger"), (2, 2, "Tanger Assilah", "طنجة أصيلة", "tanger-assilah"), (3, 3, "Oued Laou", "واد لاو", "oued-laou"), (4, 3, "Salé", None, "sale-1501"), (5, 3, "Sale", "سلا", "sale-1502")]
    return spark.createDataFrame(rows, SCHEMA)


def found(index, spark, *asked):
    rows = textsearch.search(index, spark.createDataFrame([(a,) for a in asked], "query string")).collect()
    return {(r.query, r.place): (r.entry, r.matched, r.score) for r in rows}


def test_names_of_both_scripts_are_one_entry(spark):
    aliases = spark.createDataFrame([("Tangier", 1), ("Tanger", 3), ("Nowhere", 9)], "alias string, entry int")
    index = textsearch.build_index(units(spark), aliases)
    got = found(index, spark, "طنجة", "tanger", "tangier", "tangir", "sale", "واد لاو")
    assert got["طنجة", 1] == (1, "exact", 1000.0) and got["طنجة", 2][:2] == (2, "prefix")
    assert got["tanger", 1] == (1, "exact", 1000.0) and got["tanger", 2] == (2, "prefix", 492.0)
    assert got["tangier", 1] == (1, "alias", 1000.0) and got["tangir", 1][:2] == (1, "spelling")
    assert {got["sale", k][0] for k in (1, 2)} == {4, 5} and got["واد لاو", 1][:2] == (3, "exact")
    # distinct trigrams of both names and the slug: ang nge ger tan, and two of the Arabic name
    assert {r.entry: r.grams for r in index.entries.collect()}[1] == 6
    assert index.postings.groupBy("entry", "gram").count().where("count > 1").count() == 0


def test_a_written_index_finds_the_same(spark, tmp_path):
    aliases = spark.createDataFrame([("Tangier", 1)], "alias string, entry int")
    index = textsearch.build_index(units(spark), aliases)
    root = str(tmp_path / "index")
    assert stored.opened(spark, root) is None
    stored.write_version(root, "one", textsearch.index_tables(index), buckets=16)
    again = textsearch.stored_index(stored.opened(spark, root))
    asked = ("طنجة", "tanger", "tangier", "tangir", "sal", "zz", "", "oued")
    assert found(again, spark, *asked) == found(index, spark, *asked)
    # only the buckets of a query's trigrams are read
    asked = spark.createDataFrame([("tan",)], "gram string")
    part = again.part("postings", asked)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ [=I]", plan)
    assert part.where("gram = 'tan'").count() == 2 and part.count() < again.postings.count()


def test_versions(spark, tmp_path):
    root = str(tmp_path / "tables")
    rows = lambda n: {"t": (spark.range(n).select(F.col("id").cast("string").alias("k"), F.lit(n).alias("n")), "k")}
    stored.write_version(root, "a", rows(3), buckets=4)
    stored.write_version(root, "b", rows(200), buckets=8)
    assert stored.opened(spark, root).version == "b" and stored.opened(spark, root, "a").whole("t").count() == 3 and stored.opened(spark, root, "c") is None
    asked = spark.createDataFrame([("7",), ("150",), ("x",)], "k string")
    assert {r.k for r in stored.opened(spark, root).matching("t", asked).join(asked, "k").collect()} == {"7", "150"}
    assert stored.opened(spark, root).matching("t", asked.where("false")).count() == 0


def test_kept_tables_follow_their_source(spark, tmp_path):
    source = str(tmp_path / "source")
    made = []

    def index():
        table = spark.read.parquet(source)

        def make():
            made.append(1)
            return {"t": (table, "k")}

        return stored.kept(spark, "kept-test", stored.fingerprint(table), make)

    spark.range(3).select(F.col("id").alias("k")).write.parquet(source)
    assert index().whole("t").count() == index().whole("t").count() == 3 and len(made) == 1
    spark.range(5).select(F.col("id").alias("k")).write.mode("append").parquet(source)
    assert index().whole("t").count() == 8 and len(made) == 2
