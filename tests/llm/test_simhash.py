import random

import xxhash
from pyspark.sql import functions as F

from tiersight.llm import queries, simhash

SCHEMA = "doc_id long, text string, component_id string, fp int"
WHITE = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, linked):
    top = {i: i for i in items}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(items[a], items[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def near(a, b):
    return (a ^ b).bit_count() <= 2


def test_whole_table_against_all_pairs(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    top = plain_components(prints, near)
    got = queries.op4_simhash_near_dedup(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", top[i]) for i in texts}
    assert len(got) == len(texts)


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    long = "word%d " * 3000 % tuple(range(3000))
    rows = [(1, None, "x", 7), (2, "  \n", None, None), (3, "One two", "y", 1), (3, "One two", "y", 1), (4, "one\ttwo", "", 0), (None, "one two", "z", 2), (5, long, "q", 3), (6, "ÀB cd", "q", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    two = f"{plain_fingerprint('one two'):016x}"
    assert got == sorted([(1, "0" * 16, 1), (2, "0" * 16, 1), (3, two, 3), (3, two, 3), (4, two, 3), (-1, two, None), (5, f"{plain_fingerprint(long):016x}", 5), (6, f"{plain_fingerprint('ÀB cd'):016x}", 6)])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5, 6]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_many_fingerprints_in_one_cell(spark):
    """Chains in crowded cells: more fingerprints than are paired, found through midpoints."""
    rng = random.Random(3)
    base, prints = rng.getrandbits(64), set()
    while len(prints) < 400:
        f = base
        for b in rng.sample(range(64), rng.choice([0, 1, 1, 2, 2, 3, 4])):
            f ^= 1 << b
        prints.add(f)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    items = dict(enumerate(sorted(prints, key=lambda f: hash((f, 5)))))
    signed = [(f - (1 << 64 if f >> 63 else 0), i) for i, f in items.items()]
    classes = spark.createDataFrame(signed, "fp long, rep long")
    cells = classes.select(F.explode(simhash.grid_cells(simhash.popcounts(F.col("fp")))).alias("c")).groupBy("c").count()
    assert cells.agg(F.max("count")).first()[0] > simhash.PAIRED
    links = [(r.a, r.b) for r in simhash.near_links(classes).collect()]
    assert all(near(items[a], items[b]) for a, b in links)
    top = {i: i for i in items}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    assert {i: find(i) for i in items} == plain_components(items, near)


def test_cells_are_never_broadcast(spark, monkeypatch):
    """A class has up to 33 cells and 65 midpoints, so their tables are far larger than Spark takes them for."""
    plans = []

    def stage(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    kept = simhash.stage
    monkeypatch.setattr(simhash, "stage", stage)
    classes = spark.range(100).select((F.col("id") % 7 * 3).alias("fp"), F.col("id").alias("rep")).dropDuplicates(["fp"])
    found = simhash.near_links(classes)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3 and sum(p.count("SortMergeJoin") for p in plans) >= 3
    assert not any("Broadcast" in p for p in plans)
