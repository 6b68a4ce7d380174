"""Token ids of whole texts, cut into pieces of bounded length."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersight.llm.flat import parts
from tiersight.operators.staging import stage

#: The word pattern of byte-level BPE vocabularies with 50,257 ids, as their publishers give it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoder(path: str, specials: bool = True) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizers library gives them for the file, without special tokens added.

    specials: whether special tokens' strings in a text are those tokens; else they are plain text.

    Where the file is plain byte-level BPE whose ids follow its merges, texts of Latin-1 characters
    without special tokens go through the tiktoken library over the same vocabulary, which gives the
    same ids several times faster. All others go through tokenizers itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    @lru_cache(maxsize=1)
    def exact():  # loaded where a text needs it
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = not specials
        return found

    def slow(text: str) -> np.ndarray:
        return np.array(exact().encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    special = [x["content"] for x in spec.get("added_tokens", [])]
    plain = model.get("type") == "BPE" and spec.get("normalizer") is None and spec.get("post_processor") is None
    plain = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain:
        return slow
    pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(vocab) != 256 + len(pairs):
        return slow
    import tiktoken

    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return slow(text)
        if specials and any(s in text for s in special):
            return slow(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first can be shorter than `length`."""
    first = n % length
    edges = ([0] if first else []) + list(range(first, n + 1, length))
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def pieces(docs: DataFrame, length: int, end_id: int, path: str, with_ids: bool) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) of all texts, written and read again.

    A document's ids are its text's and then `end_id`; null texts count as empty. row is a number of
    its own for each piece, also where doc_ids are null or repeated. ids are little-endian, of 16
    bits if all fit and else of 32.
    """
    width = "<u2" if encoder_fits(path, end_id) else "<u4"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in (part for whole in batches for part in parts(whole, "text")):
            ids_of = batch.column("doc_id").to_pylist()
            columns: list[list] = [[], [], [], [], [], []]
            held = 0

            def full() -> pa.RecordBatch:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], types)], names[:n])
                for c in columns:
                    c.clear()
                return out

            for doc_id, text in zip(ids_of, batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for k, (at, size) in enumerate(cut(len(ids), length)):
                    part = ids[at : at + size]
                    row = (doc_id, k, at, size, zlib.crc32(part.tobytes()), part.astype(width).tobytes() if with_ids else None)
                    for c, x in zip(columns, row):
                        c.append(x)
                    held += size
                if held > 1 << 20:
                    yield full()
                    held = 0
            if columns[0]:
                yield full()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, schema)
    return stage(found.select(F.monotonically_increasing_id().alias("row"), "*"))


def encoder_fits(path: str, end_id: int) -> bool:
    """Whether all ids of the file's vocabulary fit 16 bits."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    tokens = [*spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", [])), end_id]
    return max(tokens) < 1 << 16
