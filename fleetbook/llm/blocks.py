"""Blocks: stretches of documents as word numbers, and packed counting.

A block holds some documents of one task as a vocabulary of word hashes and
one word number per token. Operators that need a corpus-wide count for every
n-gram of every document send each block's distinct keys, packed and cut by key
range, to shards; a shard adds up the counts of its keys over all blocks and
answers each block in the order of its keys. A hot key is one entry per block,
whatever the number of its occurrences. Blocks are stored in buckets by their
name, so that only the answers travel when they meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, small_batches

#: Bytes of text in a block, unless one text is longer.
BLOCK_BYTES = 1 << 20

_BLOCK = "block string, ids array<long>, flags array<boolean>, carried array<string>, lengths binary, vocab binary, words binary"


class Block:
    """Documents of a block: ids, flags, carried values, words per document, word hashes, word numbers."""

    def __init__(self, row: dict):
        unzip = zstandard.ZstdDecompressor().decompress
        self.name, self.ids, self.flags = row["block"], row["ids"], np.array(row["flags"], dtype=bool)
        self.carried = row["carried"]
        self.lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        self.vocab = np.frombuffer(row["vocab"], dtype=np.uint64)
        planes = np.frombuffer(unzip(row["words"], max_output_size=max(1, 4 * int(self.lengths.sum()))), dtype=np.uint8)
        self.words = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the hashes of the distinct words, and all words as numbers of distinct ones.

    Words are ``words_of`` a text; Arrow splits and numbers them.
    """
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    parts = pc.ascii_split_whitespace(plain)
    # an empty text is split into one empty word
    some = np.asarray(pc.binary_length(plain)) > 0
    lengths = np.where(some, np.asarray(pc.list_value_length(parts)), 0).astype(np.int64)
    flat = parts.flatten()
    if not some.all():
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    return lengths, np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct)), np.asarray(coded.indices).astype(np.int32)


def make_blocks(docs: DataFrame, flag: Column, block_bytes: int = BLOCK_BYTES, carry: Column | None = None) -> DataFrame:
    """Blocks of the rows' (doc_id, text), with a flag and a carried text per row; stored.

    A null text counts as empty.
    """

    def build(batches):
        from uuid import uuid4

        zstd = zstandard.ZstdCompressor(level=3)

        def row(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            cols = [rows.column(i).combine_chunks() for i in range(4)]
            lengths, vocab, words = word_numbers(cols[3])
            return pa.RecordBatch.from_pylist([{
                "block": uuid4().hex, "ids": cols[0].to_pylist(), "flags": cols[1].to_pylist(), "carried": cols[2].to_pylist(), "lengths": lengths.tobytes(),
                # the numbers' bytes lie in four planes: the high ones are nearly all zero
                "vocab": vocab.tobytes(), "words": zstd.compress(words.view(np.uint8).reshape(-1, 4).T.tobytes()),
            }], schema=schema)

        held, size = [], 0
        for batch in batches:
            begin = 0
            for i, n in enumerate(np.asarray(pc.fill_null(pc.binary_length(batch.column(3)), 0)).tolist()):
                size += n
                if size >= block_bytes:
                    held.append(batch.slice(begin, i + 1 - begin))
                    yield row(held)
                    held, size, begin = [], 0, i + 1
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield row(held)

    schema = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("carried", pa.list_(pa.string())), ("lengths", pa.binary()), ("vocab", pa.binary()), ("words", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("flag"), (F.lit(None) if carry is None else carry).cast("string").alias("carried"), "text")
    return bucketed(small_batches(rows).mapInArrow(build, _BLOCK), "block", "blocks")


def shard_bits(spark) -> int:
    """Bits of a key that name its shard: at least 256 shards, one for every shuffle partition or more."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())


def cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards in sorted 64-bit keys, and where they begin (one more than shards)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    return shard[first], np.append(first, len(keys))
