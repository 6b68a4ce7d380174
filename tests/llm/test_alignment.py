import hashlib
import itertools
from collections import Counter

import pytest

from tiersight.llm import alignment, queries

TEXTS = [
    "", None, " ", "  two  spaces ", "plain words here", "naïve — “quoted” 日本語 \x00 \n\n\t end", "the <|endoftext|> is plain <s> <unk> <0x41>", "a ▁ b", "ﬁ ① é", "😀😀 word😀",
    "plain words here", "1234567890 1234567890", "x", "\x1f\x85\xa0 ", "word " * 3000, "don't WE'LL ça va être",
]


@pytest.fixture(scope="module")
def coders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=b_path)


def spans(lengths):
    lengths = list(lengths)
    ends = list(itertools.accumulate(lengths))
    return [(e - n, e) for e, n in zip(ends, lengths)]


def plain_tokens(text, coders):
    """(ids, byte ranges) of both sides by the libraries' own decoders; None where bytes differ."""
    if not text:
        return None
    a, b = coders
    want = f" {text}".encode()
    letters = {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = 256
    for x in range(256):
        if x in shown:
            letters[chr(x)] = x
        else:
            letters[chr(spare)] = x
            spare += 1
    found = a.encode(f" {text}", add_special_tokens=False)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in found.ids]
    b_ids = b.encode(text)
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return None
    return found.ids, spans(map(len, a_bytes)), b_ids, spans(map(len, b_bytes))


def brute_force(rows, coders):
    counts, kept = Counter(), []
    for doc_id, text in rows:
        found = plain_tokens(text, coders)
        links, groups = [], []
        if found:
            a, at_a, b, at_b = found
            lo = 0
            for i, (s, e) in enumerate(at_a):
                while at_b[lo][1] <= s:
                    lo += 1
                j = lo
                while j < len(b) and at_b[j][0] < e:
                    links.append((a[i], b[j]))
                    j += 1
            ends = {e for _, e in at_a} & {e for _, e in at_b}
            by = [{}, {}]
            for side, ids, at in ((0, a, at_a), (1, b, at_b)):
                k = 0
                for x, (_, e) in zip(ids, at):
                    by[side].setdefault(k, []).append(str(x))
                    k += e in ends
            groups = [f"{','.join(by[0][k])}|{','.join(by[1][k])}" for k in range(len(ends))]
        counts.update(links)
        kept.append((doc_id, found, links, groups))
    top = {}
    for (a, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for doc_id, found, links, groups in kept:
        written = ";".join(groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if found else ""
        out.append((doc_id, len(found[0]) if found else 0, len(found[2]) if found else 0, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str), counts, top


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_whole_table(spark, sf, coders):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op11_tokenizer_alignment(spark, sf)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(rows, coders)[0]


@pytest.mark.parametrize("chunk", [1, 64, 1 << 24])
def test_odd_texts_over_chunks(spark, coders, monkeypatch, chunk):
    """Nulls, empties, texts that don't come back whole, repeated and null ids, special tokens, clashing columns."""
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, pairs string").repartition(3)
    found = alignment.align(docs, written=True)
    want, counts, top = brute_force(rows, coders)
    got = found.documents.collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == want
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in got)
    assert {(r.a, r.b): (r["count"], r.best) for r in found.pairs.collect()} == {k: (n, n == top[k[1]]) for k, n in counts.items()}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = alignment.align(docs)
    assert found.documents.count() == 0 and found.pairs.count() == 0
    only_null = alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).documents.collect()
    assert [tuple(r) for r in only_null] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_planes_come_back():
    import numpy as np

    for numbers in ([], [0], [1, 2**32 - 1, 256, 65_536]):
        assert alignment.unpacked(alignment.packed(np.array(numbers, np.int64))).tolist() == numbers
