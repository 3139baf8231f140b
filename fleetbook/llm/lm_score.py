"""LM scoring with a weighted backoff automaton.

The model is a bigram model with interpolated absolute discounting over
add-one unigrams. As an automaton: a state for each word that the training
tokens continue, and a root; an arc for each bigram seen in training, with its
smoothed log probability; and from each state a failure arc to the root, with
the log of the weight left over, where each word has its unigram's log
probability. A document is read from left to right from the state of an end
token; each token follows its arc, or the failure arc and then the root's, and
leads to its own state.

Counts cover all training documents. Each block of documents sends its distinct
words and bigrams to shards, which add up counts over all blocks and answer
with them, so a block builds the part of the automaton that its documents can
reach, with corpus-wide weights, and no model passes through the driver.
Bigrams are sharded by both words, so a frequent first word is spread;
words are told apart by 64-bit hashes in their own counts, and by 36 bits of them
where a word's distinct followers are counted. Bigrams are told apart by 36 bits of the
first word's hash and 32 (with the shard's, some 36) of the second's: of ten
million words a few thousand share their 36 bits with another.

Defined cases: a null or empty text is one end token; without training
documents every word is unknown (N = 0, V = 0); repeated rows are scored each
on its own; texts are read whole, whatever their length; an empty table gives no
rows. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, cut, make_blocks, shard_bits
from .common import mix, run_starts, segment_sums, staged

#: Discount of every seen bigram's count.
DISCOUNT = 0.75
#: The end token's key: no hash function is applied to it.
END = 0x656E64206F662074

_SENT = "kind int, shard int, block string, a binary, b binary, n binary"
_SENT_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])
_ANSWER = "block string, kind int, shard int, n binary, m binary"

UNI, BI, FOLLOW = 0, 1, 2


class Grams:
    """A block's tokens with ends, its distinct words and bigrams, all in key order."""

    def __init__(self, block: Block, bits: int):
        self.bits = bits
        vocab = np.append(block.vocab, np.uint64(END))
        order = np.argsort(vocab)
        rank = np.empty(len(vocab), dtype=np.int64)
        rank[order] = np.arange(len(vocab))
        self.vocab = vocab[order]
        end = rank[-1]
        starts = run_starts(block.lengths + 1)
        self.starts = starts
        tokens = np.full(starts[-1], end, dtype=np.int64)
        is_end = np.zeros(starts[-1], dtype=bool)
        is_end[starts[1:] - 1] = True
        tokens[~is_end] = rank[block.words]
        self.tokens = tokens
        prev = np.empty_like(tokens)
        prev[1:] = tokens[:-1]
        prev[starts[:-1]] = end
        pair = prev * len(vocab) + tokens
        self.pairs, self.pair_of = np.unique(pair, return_inverse=True)
        self.trained = np.repeat(block.flags, block.lengths + 1)
        self.first, self.second = self.pairs // len(vocab), self.pairs % len(vocab)
        # shards of bigrams: by the second word within those of the first
        half = bits // 2
        a, b = self.vocab[self.first], self.vocab[self.second]
        self.pair_shard = (((a >> np.uint64(64 - (bits - half))) << np.uint64(half)) | (mix(b) >> np.uint64(64 - half))).astype(np.int64)
        self.pair_order = np.argsort(self.pair_shard, kind="stable")

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.trained], minlength=len(self.vocab))

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.trained], minlength=len(self.pairs))

    def pair_cuts(self) -> tuple[np.ndarray, np.ndarray]:
        shard = self.pair_shard[self.pair_order]
        first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        return shard[first], np.append(first, len(shard))


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers as eight planes of their bytes: those of small numbers are nearly all zero."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _first36(keys: np.ndarray) -> np.ndarray:
    """The 36 high bits of a hash."""
    return keys >> np.uint64(28)


def send(blocks: DataFrame, bits: int) -> DataFrame:
    """Messages of all blocks: counts of words and of bigrams by shard."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                g = Grams(block, bits)
                counts = g.word_counts().astype(np.int32)
                out = []
                shards, at = cut(g.vocab, bits)
                for s, x, y in zip(shards, at, at[1:], strict=False):
                    out.append((UNI, int(s), block.name, g.vocab[x:y].tobytes(), b"", counts[x:y].tobytes()))
                counts = g.pair_counts().astype(np.int32)[g.pair_order]
                a, b = g.vocab[g.first[g.pair_order]], mix(g.vocab[g.second[g.pair_order]])
                shards, at = g.pair_cuts()
                for s, x, y in zip(shards, at, at[1:], strict=False):
                    # the first word's 36 high bits, the second word's 32 bits below the shard's
                    second = (b[x:y] >> np.uint64(32 - bits // 2)).astype(np.uint32)
                    out.append((BI, int(s), block.name, _first36(a[x:y]).tobytes(), second.tobytes(), counts[x:y].tobytes()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SENT_ARROW, strict=True)], schema=_SENT_ARROW)

    return blocks.mapInArrow(run, _SENT)


def _added(table: pa.Table, wide: bool):
    """Rows of a shard, their lengths, distinct keys, the key of each entry, and summed counts."""
    a = [np.frombuffer(x, dtype=np.uint64) for x in table["a"].to_pylist()]
    n = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in table["n"].to_pylist()]).astype(np.int64)
    key = np.concatenate(a)
    if wide:
        b = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table["b"].to_pylist()])
        # the shard fixes 4 or more of the 36 bits: those that the shift drops
        key = (key << np.uint64(32)) | b
    keys, of = np.unique(key, return_inverse=True)
    total = np.bincount(of, weights=n, minlength=len(keys)).astype(np.int64)
    return [len(x) for x in a], keys, of, total


def count_pairs(sent: DataFrame, bits: int) -> DataFrame:
    """Answers to blocks (kind BI), and the distinct followers of first words (kind FOLLOW)."""

    def run(table):
        lengths, keys, of, total = _added(table, True)
        answer, out, at = total[of], [], 0
        for block, shard, n in zip(table["block"].to_pylist(), table["shard"].to_pylist(), lengths, strict=True):
            out.append((block, BI, shard, planes(answer[at : at + n]), b""))
            at += n
        first, kinds = np.unique(keys[total > 0] >> np.uint64(32), return_counts=True)
        low = 36 - (bits - bits // 2)
        first = (first & np.uint64((1 << low) - 1)) | np.uint64((table["shard"][0].as_py() >> (bits // 2)) << low)
        # by first word, for the shard of its own count
        owner = (first >> np.uint64(36 - bits)).astype(np.int64)
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
        for x, y in zip(at, np.append(at[1:], len(owner)), strict=False):  # no entry: no cut
            out.append(("", FOLLOW, int(owner[x]), first[x:y].tobytes(), kinds[x:y].astype(np.int64).tobytes()))
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "kind", "shard", "n", "m"])

    return sent.filter(F.col("kind") == BI).groupBy("shard").applyInArrow(run, _ANSWER)


def count_words(sent: DataFrame, follow: DataFrame) -> DataFrame:
    """Answers to blocks (kind UNI): counts and followers; and a row of (tokens, types) per shard."""

    def run(left, right):
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())], names=["block", "kind", "shard", "n", "m"])
        lengths, keys, of, total = _added(left, False)
        first = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in right["n"].to_pylist()] or [np.zeros(0, np.uint64)])
        kinds = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in right["m"].to_pylist()] or [np.zeros(0, np.int64)])
        firsts, pos = np.unique(first, return_inverse=True)
        added = np.bincount(pos, weights=kinds, minlength=len(firsts) + 1).astype(np.int64)
        short = _first36(keys)
        at = np.minimum(np.searchsorted(firsts, short), max(0, len(firsts) - 1))
        followers = np.where(firsts[at] == short, added[at], 0) if len(firsts) else np.zeros(len(keys), np.int64)
        n, m, out, at = total[of], followers[of], [], 0
        for block, shard, k in zip(left["block"].to_pylist(), left["shard"].to_pylist(), lengths, strict=True):
            out.append((block, UNI, shard, n[at : at + k].tobytes(), m[at : at + k].tobytes()))
            at += k
        out.append(("", UNI, left["shard"][0].as_py(), np.array([total.sum()], np.int64).tobytes(), np.array([(total > 0).sum()], np.int64).tobytes()))
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "kind", "shard", "n", "m"])

    return sent.filter(F.col("kind") == UNI).groupBy("shard").cogroup(follow.groupBy("shard")).applyInArrow(run, _ANSWER)


class BackoffAutomaton:
    """States, arcs and failure arcs over a block's words.

    ``root[w]``: log10 P(w). ``failure[s]``: log10 of the weight left over in
    state ``s`` (0 where it has no arcs). ``arc[k]``: log10 probability of
    bigram ``k``, or -inf where there is no such arc.
    """

    def __init__(self, words: np.ndarray, followers: np.ndarray, pairs: np.ndarray, first: np.ndarray, second: np.ndarray, tokens: int, types: int):
        uni = (words + 1) / (tokens + types + 1)
        live = (words > 0) & (followers > 0)
        left = np.where(live, np.minimum(1.0, DISCOUNT * followers / np.maximum(words, 1)), 1.0)
        self.root, self.failure = np.log10(uni), np.log10(left)
        seen = pairs > 0
        p = np.maximum(pairs - DISCOUNT, 0) / np.maximum(words[first], 1) + left[first] * uni[second]
        self.arc = np.where(seen, np.log10(np.where(seen, p, 1.0)), -np.inf)

    def traverse(self, states: np.ndarray, tokens: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """The weight each token adds when read in the state that the token before led to."""
        arc = self.arc[arcs]
        return np.where(np.isfinite(arc), arc, self.failure[states] + self.root[tokens])


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bits = shard_bits(spark)
    blocks = make_blocks(docs, learn)
    sent = send(blocks, bits)
    paired = staged(count_pairs(sent, bits), "lm-pairs")
    worded = staged(count_words(sent, paired.filter(F.col("kind") == FOLLOW)), "lm-words")
    totals = worded.filter("block = ''").select("n", "m").toArrow()
    tokens, types = (sum(int(np.frombuffer(x, dtype=np.int64)[0]) for x in totals[c].to_pylist()) for c in ("n", "m"))
    answers = paired.filter(F.col("kind") == BI).unionByName(worded.filter("block <> ''"))

    def run(left, right):
        block = Block(left.to_pylist()[0])
        g = Grams(block, bits)
        kind, shard = right["kind"].to_numpy(), right["shard"].to_numpy()
        n, m = right["n"].to_pylist(), right["m"].to_pylist()
        of = lambda k: sorted(np.flatnonzero(kind == k), key=lambda i: shard[i])
        words = np.concatenate([np.frombuffer(n[i], dtype=np.int64) for i in of(UNI)])
        followers = np.concatenate([np.frombuffer(m[i], dtype=np.int64) for i in of(UNI)])
        pairs = np.empty(len(g.pairs), dtype=np.int64)
        pairs[g.pair_order] = np.concatenate([from_planes(n[i]) for i in of(BI)])
        automaton = BackoffAutomaton(words, followers, pairs, g.first, g.second, tokens, types)
        states = g.first[g.pair_of]
        added = automaton.traverse(states, g.tokens, g.pair_of)
        return pa.table({
            "doc_id": pa.array(block.ids, pa.int64()), "held_out": pa.array(~block.flags), "n_tokens": pa.array(block.lengths + 1),
            "n_known": pa.array(segment_sums((words > 0).astype(np.int64)[g.tokens], g.starts)), "train_tokens": pa.array(np.full(len(block.ids), tokens, dtype=np.int64)),
            "base_score": pa.array(segment_sums(automaton.root[g.tokens], g.starts)), "score": pa.array(segment_sums(added, g.starts)),
        })

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _OUT)
