import zlib

import numpy as np

from tiersight.llm import quality, queries


def test_held_out_fifth_is_told_apart(spark, sf):
    docs, labels = queries.table(spark, "/root/testdata/sf0.01", "documents"), queries.table(spark, "/root/testdata/sf0.01", "labels")
    got = queries.op9_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(judged) > 50 and np.mean([a == b for a, b in judged]) >= 0.97


def test_nulls_empty_texts_extra_columns_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 5.0, "a"), (2, "", 1.0, "b"), (None, "good words here", None, "c"), (3, "bad " * 50_000, 2.0, "d"), (3, "bad " * 9, 2.0, "d")], "doc_id long, text string, score double, held_out string")
    labels = spark.createDataFrame([(3, 0, "x"), (3, 1, "y"), (None, 1, "z"), (2, None, "")], "doc_id long, quality int, score string")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = quality.quality_scores(docs, labels.where("false")).collect()
    assert [r.score for r in none] == [0.5] * 5
    assert quality.quality_scores(docs.where("false"), labels).count() == 0
    kept = quality.keep_good(docs, labels.where("false"))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_term_counts_cover_the_whole_text():
    a = quality.term_counts([b"x " * 10, b"", b"Ab ab"])
    assert a[0, : quality.WORDS].sum() == 10 and a[0, -1] == 9
    assert a[1, : quality.WORDS].sum() == 0 and a[2, -1] == 1


def test_counts_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"one two", b"", b"7", b"x y", "é".encode(), b"three\nlines\nhere"]
    together = quality.term_counts(texts)
    assert all((quality.term_counts([t])[0] == row).all() for t, row in zip(texts, together))


def test_votes_are_those_of_the_nearest(spark, sf):
    """Every score against the cosines of one document with each labelled vector, one by one."""
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    counts, marked = quality.sample_counts(docs, labels, 4096)
    model = quality.fit(counts, marked)
    rows = docs.collect()
    seen = quality.term_counts([(r.text or "").encode() for r in rows])
    got = quality.score(model, seen, block=len(rows))
    marks = np.asarray(model.quality, np.float64)
    vectors = model.vectors.astype(np.float64)
    for score, one in zip(got, quality.placed(model, seen)):
        cosines = [round(float(v @ one), 6) for v in vectors]
        last = sorted(cosines, reverse=True)[min(model.neighbours, len(marks)) - 1]
        votes = [(max(c, 1e-3) ** model.power, q) for c, q in zip(cosines, marks) if c >= last]
        assert abs(score - sum(w * q for w, q in votes) / sum(w for w, _ in votes)) < 1e-8


def test_all_copies_at_the_last_place_vote():
    rng = np.random.default_rng(2)
    counts = np.repeat(rng.poisson(0.02, (40, quality.TERMS)).astype(np.float32), 3, axis=0)
    model = quality.fit(counts, np.arange(len(counts)) % 2, dims=8, neighbours=4)
    got = quality.score(model, counts[:1])
    cosines = np.round(model.vectors.astype(np.float64) @ quality.placed(model, counts[:1])[0], 6)
    last = np.sort(cosines)[-4]
    votes = cosines >= last
    assert votes.sum() > 4
    weight = np.maximum(cosines[votes], 1e-3) ** model.power
    assert abs(got[0] - weight @ (np.arange(len(counts))[votes] % 2) / weight.sum()) < 1e-8


def test_scores_do_not_depend_on_partitions(spark):
    """Ties of copies included: as read, dealt out anew, and in blocks of other sizes."""
    docs, labels = queries.table(spark, "/root/testdata/sf0.01", "documents"), queries.table(spark, "/root/testdata/sf0.01", "labels")
    one = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    other = {r.doc_id: r.score for r in quality.quality_scores(docs.repartition(7, "text"), labels.repartition(3)).collect()}
    assert one == other
