import zlib
from collections import defaultdict

import numpy as np
import pytest

from tiersight.llm import genetic, packing, queries, tokens

ROWS = [(1, None, 1), (2, "", 2), (2, "", 2), (None, "Hello, world", 3), (5, "word " * 30_000, 4), (6, "naïve — “quoted” 日本語 <|endoftext|> \x00 \n\n  end", 5)]
SCHEMA = "doc_id long, text string, offset int"


def exact_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizers_library(spark, sf):
    encode = tokens.encoder(tokens.default_path())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += [t for _, t, _ in ROWS] + ["  a b\x85c ", "\xad\xb5ª²¼ÿ", "don't WE'LL 123abc  \t\n x", "a" * 3000, " " * 300 + "x"]
    for text in texts:
        assert encode(text or "").tolist() == exact_ids(text)


def checked(pieces, docs, length, end_id):
    """Pieces are lossless and sequences gapless; returns the number of sequences."""
    bins = defaultdict(list)
    got = defaultdict(list)
    for doc_id, piece, start, size, crc, sequence_id, offset, *_ in pieces:
        bins[sequence_id].append((offset, size))
        got[doc_id].append((piece, start, size, crc))
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = [*exact_ids(text), end_id]
        for k, (at, n) in enumerate(tokens.cut(len(ids), length)):
            want[doc_id].append((k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
        assert sum(n for _, n in tokens.cut(len(ids), length)) == len(ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for content in bins.values():
        at = 0
        for offset, size in sorted(content):
            assert offset == at
            at += size
        assert at <= length
    return len(bins), sum(n for b in bins.values() for _, n in b)


def test_genetic_packing_of_a_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op5_best_fit_packing(spark, sf).collect()]
    n, total = checked(got, docs, 2048, 0)
    assert n <= -(-total // 2048) + 1


def test_genetic_packing_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = [tuple(r) for r in genetic.genetic_packing(docs).collect()]
    checked(got, [(r[0], r[1]) for r in ROWS], 2048, 0)
    assert genetic.genetic_packing(docs.where("false")).count() == 0


def test_islands_over_several_shards_and_levels(spark):
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in [*rng.integers(300, 700, 900), *[430] * 400]]
    rows = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    search = genetic.Search(shard_rows=200, islands=2, epochs=2, generations=3)
    got = genetic.genetic_places(rows, 1000, search).collect()
    assert sorted(r.row for r in got) == list(range(len(lengths)))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, lengths[r.row]))
    for content in bins.values():
        ends = np.cumsum([0, *[n for _, n in sorted(content)]])
        assert ends[-1] <= 1000 and [o for o, _ in sorted(content)] == ends[:-1].tolist()
    plain = packing.plan({n: lengths.count(n) for n in set(lengths)}, 1000)[1]
    assert len(bins) <= 1.02 * plain


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 1000, 500))[::-1].copy()
    a, b = (genetic.seeded(lengths, 1000, n, rng) for n in (0.0, 0.5))
    for _ in range(20):
        child = genetic.crossover(lengths, a, b, 1000, rng)
        assert len(child) == 500 and np.bincount(child, weights=lengths).max() <= 1000 and np.bincount(child).min() > 0
        a, b = b, child


def plain_best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(8))
def test_counted_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, rng.choice([20, 60, 100]), rng.integers(1, 400)).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    moves, bins = packing.plan(counts, 100)
    left = [100] * bins
    ranks = defaultdict(list)
    for m in moves:
        ranks[m.length] += range(m.lo, m.hi)
        for t in range(m.hi - m.lo):
            b = m.bin + t // m.each
            assert 100 - left[b] == m.offset + t % m.each * m.length
            left[b] -= m.length
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
    assert sorted(left) == plain_best_fit(lengths, 100)


def round_trip(packed, length):
    docs = defaultdict(list)
    for r in packed:
        ids, at = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(at) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        for a, b, doc, piece, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces, r.starts, strict=False):
            assert at[a:b].tolist() == list(range(b - a))
            docs[doc].append((piece, start, ids[a:b].tolist()))
    return docs


def test_matrices_round_trip(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    packed = queries.op1_token_matrices(spark, sf).collect()
    docs = round_trip(packed, 2048)
    assert docs.keys() == texts.keys() and len({r.sequence_id for r in packed}) == len(packed)
    for doc, found in docs.items():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert [x for _, _, ids in found for x in ids] == [*exact_ids(texts[doc]), 50256]
    total = sum(r.n_tokens for r in packed)
    assert len(packed) <= -(-total // 2048) + 2


def test_matrices_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = round_trip(packing.packed_matrices(docs, length=64).collect(), 64)
    assert sorted(found, key=str) == sorted({r[0] for r in ROWS}, key=str)
    assert sorted(found[2]) == [(0, 0, [50256]), (0, 0, [50256])]
    assert [x for _, _, ids in sorted(found[5]) for x in ids] == [*exact_ids(ROWS[4][1]), 50256]
    assert packing.packed_matrices(docs.where("false")).count() == 0


def test_fast_ids_of_all_latin_pairs_and_entries():
    """Texts that go through tiktoken have the ids of tokenizers: every pair of Latin-1 characters, and every entry of the vocabulary."""
    from tokenizers import Tokenizer

    path = tokens.default_path()
    plain, encode = Tokenizer.from_file(path), tokens.encoder(path)
    byte_of = tokens._byte_of()
    entries = [bytes(byte_of[c] for c in k).decode("latin-1") for k in plain.get_vocab() if all(c in byte_of for c in k)]
    pairs = [f"{chr(a)}{chr(b)}a{chr(b)} {chr(a)}" for a in range(256) for b in range(256)]
    for texts in (pairs, entries, [" ".join(entries[i::97]) for i in range(97)]):
        for text, found in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
            assert encode(text).tolist() == found.ids


def test_search_beats_best_fit_decreasing(spark):
    """Triplets that fill sequences: best fit decreasing pairs the wrong ones, recombination finds better."""
    rng = np.random.default_rng(4)
    lengths = []
    for _ in range(80):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(max(250, 500 - a // 2 - 100), (1000 - a) // 2))
        lengths += [a, b, 1000 - a - b]
    plain = packing.plan({n: lengths.count(n) for n in set(lengths)}, 1000)[1]
    rows = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    got = genetic.genetic_places(rows, 1000, genetic.Search(epochs=3, generations=60, population=12)).collect()
    assert len({r.sequence_id for r in got}) < plain and max(r.generations for r in got) > 0


def test_levels_end_where_nothing_is_saved(spark):
    """Pieces of which no two fit together leave room everywhere, and are dealt out twice at most."""
    rows = spark.createDataFrame([(i, 600) for i in range(900)], "row long, length long")
    got = genetic.genetic_places(rows, 1000, genetic.Search(shard_rows=100, islands=1, epochs=1)).collect()
    assert len(got) == 900 == len({r.sequence_id for r in got})
