"""N-gram Jaccard join with several global token orders.

A document's tokens are its distinct word shingles. Under any one order of all
tokens, two sets with Jaccard similarity t or more share a token among the
first ``n - ceil(t * n) + 1`` of each. All orders here put rare tokens first:
by document frequency, with ties broken by a different hash in each. So tokens
of one document only come first; a document whose prefix consists of them has
no partner, and only the others go on. Frequencies are counted over all
documents (``blocks``). Candidates share a prefix token under every order: the
first order's posting lists bring documents together, the other orders'
prefixes are intersected with that, and only what is left is verified, by
exact intersection sizes.

Equal sets are one class. A posting list is led by its smallest class, and lists
with the same leader are one group, so near copies that share many tokens
meet once. A group is cut into sub-blocks and every pair of sub-blocks is a
task of its own, in which pairs are compared in arrays and only a spanning
forest of the links leaves the task; no list of pairs is made.

Shingles are told apart by 64-bit hashes; frequencies by the hash's high bits,
which only affects the order. Defined cases: a null, empty or blank text has an empty
set and links with nothing; fewer words than a shingle make one shingle of all
words; a null doc_id takes part in links but is never a component's id unless
all ids are null; repeated rows link with each other; texts are read whole,
whatever their length; an empty table gives no rows. Only id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, cut, make_blocks, shard_bits
from .common import MULT, U64, distinct_sorted, mix, run_starts, staged
from .components import components, forest

#: Members and tokens of a sub-block.
SUB_MEMBERS, SUB_TOKENS = 1024, 1 << 21


def shingle_sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted distinct shingle hashes, end to end, and their offsets."""
    h = block.vocab[block.words]
    starts = run_starts(block.lengths)
    n = len(h) - width + 1
    rolled = np.full(max(0, n), U64(width), dtype=np.uint64)
    for k in range(width):
        if n > 0:
            rolled = mix(rolled * MULT + h[k : k + n])
    sets = []
    for a, b in zip(starts, starts[1:], strict=False):
        if b - a >= width:
            sets.append(distinct_sorted(rolled[a : b - width + 1]))
        elif b > a:
            z = np.array([b - a], dtype=np.uint64)
            for x in h[a:b]:
                z = mix(z * MULT + x)
            sets.append(z)
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), run_starts(np.array([len(s) for s in sets], dtype=np.int64))


def signature(shingles: np.ndarray) -> int:
    """The class of a set: a 64-bit hash of its sorted shingles."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` among which a partner's prefix must be met."""
    return n + (-percent * n // 100) + 1


#: Tie breaks of the global orders: each is a different permutation of the hashes.
ORDERS = (lambda t: t, lambda t: ~t, lambda t: mix(t))


def prefix(tokens: np.ndarray, df: np.ndarray, slots: int, order: int) -> np.ndarray:
    """The first ``slots`` of the shared tokens under one order."""
    if slots >= len(tokens):
        return tokens
    return tokens[np.lexsort((ORDERS[order](tokens), df))[:slots]]


_SENT = "shard int, block string, a binary, n binary"
_DOCS = "doc_id long, carried string, words long, n_shingles long, own long, sig long, slots int, tokens binary, df binary"


def _frequencies(blocks: DataFrame, width: int, bits: int) -> DataFrame:
    """For each block and shard, the frequencies (255 at most) of the block's keys, in order."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                values, _ = shingle_sets(block, width)
                keys, counts = np.unique(values >> U64(32 - bits), return_counts=True)
                shards, at = cut(keys << U64(32 - bits), bits)
                out = [(int(s), block.name, keys[x:y].astype(np.uint32).tobytes(), np.minimum(counts[x:y], 255).astype(np.uint8).tobytes()) for s, x, y in zip(shards, at, at[1:], strict=False)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "a", "n"])

    def add(table):
        a = [np.frombuffer(x, dtype=np.uint32) for x in table["a"].to_pylist()]
        n = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in table["n"].to_pylist()])
        keys, of = np.unique(np.concatenate(a), return_inverse=True)
        answer = np.minimum(np.bincount(of, weights=n, minlength=len(keys)), 255).astype(np.uint8)[of]
        cuts = run_starts(np.array([len(x) for x in a]))
        return pa.table({"block": table["block"], "shard": table["shard"], "df": pa.array([answer[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    return blocks.mapInArrow(send, _SENT).groupBy("shard").applyInArrow(add, "block string, shard int, df binary")


def _documents(blocks: DataFrame, answers: DataFrame, width: int, percent: int, bits: int) -> DataFrame:
    """One row per document: its id, carried value, words, set size and ``own`` signature;
    for those that may have a partner also ``sig`` (the same) and the tokens they share."""

    def run(left, right):
        block = Block(left.to_pylist()[0])
        values, starts = shingle_sets(block, width)
        short = values >> U64(32 - bits)
        keys = distinct_sorted(short)
        by_shard = sorted(zip(right["shard"].to_pylist(), right["df"].to_pylist(), strict=True))
        df_of = np.concatenate([np.frombuffer(x, dtype=np.uint8) for _, x in by_shard]) if by_shard else np.zeros(0, np.uint8)
        df = df_of[np.searchsorted(keys, short)]
        sizes, own, sig, slots, tokens, dfs = np.diff(starts), [], [], [], [], []
        alone = np.diff(run_starts((df == 1).astype(np.int64))[starts])
        for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            own.append(signature(values[a:b]) if sizes[k] else None)
            left_over = prefix_length(int(sizes[k]), percent) - int(alone[k])
            if sizes[k] == 0 or left_over <= 0:
                for out in (sig, slots, tokens, dfs):
                    out.append(None)
                continue
            shared = df[a:b] > 1
            sig.append(own[-1])
            slots.append(left_over)
            tokens.append(values[a:b][shared].tobytes())
            dfs.append(df[a:b][shared].tobytes())
        return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "carried": pa.array(block.carried, pa.string()), "words": pa.array(block.lengths), "n_shingles": pa.array(sizes), "own": pa.array(own, pa.int64()), "sig": pa.array(sig, pa.int64()), "slots": pa.array(slots, pa.int32()), "tokens": pa.array(tokens, pa.binary()), "df": pa.array(dfs, pa.binary())})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _DOCS)


def _postings(classes: DataFrame) -> DataFrame:
    """(token, sig): the first order's prefix tokens of each class."""

    def run(batches):
        for batch in batches:
            token, owner = [], []
            for x in batch.to_pylist():
                t = prefix(np.frombuffer(x["tokens"], dtype=np.uint64), np.frombuffer(x["df"], dtype=np.uint8), x["slots"], 0)
                token.append(t.view(np.int64))
                owner.append(np.full(len(t), x["sig"], dtype=np.int64))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.concatenate(owner))], ["token", "sig"])

    return classes.select("sig", "slots", "tokens", "df").mapInArrow(run, "token long, sig long")


class Members:
    """Some classes of a group, with tokens numbered within the task."""

    def __init__(self, rows: list[dict]):
        self.sig = np.array([x["sig"] for x in rows], dtype=np.int64)
        self.n = np.array([x["n"] for x in rows], dtype=np.int64)
        self.whole = [np.frombuffer(x["tokens"], dtype=np.uint64) for x in rows]
        df = [np.frombuffer(x["df"], dtype=np.uint8) for x in rows]
        self.prefixes = [[prefix(t, d, x["slots"], o) for t, d, x in zip(self.whole, df, rows, strict=True)] for o in range(len(ORDERS))]


class Lists:
    """Posting lists of some sets: token -> positions."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.where = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        self.tokens, first = np.unique(flat[order], return_index=True)
        self.ends = np.append(first, len(flat))

    def shared(self, tokens: np.ndarray, size: int) -> np.ndarray:
        """How many of ``tokens`` each set has."""
        at = np.searchsorted(self.tokens, tokens)
        held = at < len(self.tokens)
        at, tokens = at[held], tokens[held]
        at = at[self.tokens[at] == tokens]
        if not len(at):
            return np.zeros(size, dtype=np.int64)
        begin, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        spots = np.repeat(begin - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return np.bincount(self.where[spots], minlength=size)


def links_between(left: Members, right: Members, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between (or, if ``same``, within) sub-blocks."""
    lists = [Lists(p) for p in right.prefixes]
    whole = Lists(right.whole)
    size, a, b = len(right.sig), [], []
    for i in range(len(left.sig)):
        near = np.ones(size, dtype=bool)
        if same:
            near[: i + 1] = False
        low = np.minimum(left.n[i], right.n)
        near &= 100 * low >= percent * np.maximum(left.n[i], right.n)
        for o, one in enumerate(lists):
            if not near.any():
                break
            near &= one.shared(left.prefixes[o][i], size) > 0
        if not near.any():
            continue
        inter = whole.shared(left.whole[i], size)
        hit = np.flatnonzero(near & (100 * inter >= percent * (left.n[i] + right.n - inter)))
        a.append(np.full(len(hit), left.sig[i]))
        b.append(right.sig[hit])
        if len(a) >= 256:
            u, v = forest(np.concatenate(a), np.concatenate(b))
            a, b = [u], [v]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(a), np.concatenate(b))


def _verified(tasks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of rows sorted by (leader, i, j); one task's rows are held at a time."""

    def judge(rows):
        i, j = rows[0]["i"], rows[0]["j"]
        left = Members([x for x in rows if x["part"] == i])
        right = left if i == j else Members([x for x in rows if x["part"] == j])
        return links_between(left, right, i == j, percent)

    def run(batches):
        held, key = [], None
        for batch in batches:
            a, b = [], []
            for x in batch.to_pylist():
                now = x["leader"], x["i"], x["j"]
                if now != key and held:
                    u, v = judge(held)
                    a.append(u)
                    b.append(v)
                    held = []
                key = now
                held.append(x)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])
        if held:
            u, v = judge(held)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])

    return tasks.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame, width: int, percent: int, carry: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents (with the value of ``carry``), and (node, least, root) of each class that may have a partner:
    its signature, its smallest id and the smallest signature linked with it."""
    bits = shard_bits(docs.sparkSession)
    blocks = make_blocks(docs, F.lit(True), carry=carry)
    table = staged(_documents(blocks, _frequencies(blocks, width, bits), width, percent, bits), "ngram-docs")
    active = table.filter("sig is not null")
    classes = staged(active.groupBy("sig").agg(F.min("doc_id").alias("least"), (F.max(F.length("tokens")) / 8).alias("weight")), "ngram-classes")
    postings = staged(_postings(active).distinct(), "ngram-postings")
    leaders = postings.groupBy("token").agg(F.min("sig").alias("leader"), F.count("*").alias("k")).filter("k > 1")
    members = postings.join(leaders, "token").select("leader", "sig").distinct()
    members = staged(members.join(classes.select("sig", "weight"), "sig"), "ngram-members")
    parts = members.groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / SUB_MEMBERS, F.sum("weight") / SUB_TOKENS)).cast("int").alias("parts"))
    placed = members.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("sig", "leader"), F.col("parts")).cast("int"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("leader", "sig", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    sets = active.groupBy("sig").agg(*[F.first(src).alias(c) for c, src in (("n", "n_shingles"), ("slots", "slots"), ("tokens", "tokens"), ("df", "df"))])
    links = _verified(tasks.join(sets, "sig"), percent)
    roots = components(links)
    named = classes.select(F.col("sig").alias("node"), "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return table, named


def _with_classes(table: DataFrame, classes: DataFrame) -> DataFrame:
    """``table`` with what ``classes`` say of its rows' ``sig`` (their ``node``).

    Rows without a partner have no class: they are spread by their own signature, or
    else by a hash, instead of meeting under one missing key.
    """
    spread = F.coalesce("sig", "own", F.xxhash64("doc_id", "carried"))
    said = [c for c in classes.columns if c != "node"]
    joined = table.withColumn("at", spread).join(classes.withColumnRenamed("node", "at"), "at", "left")
    return joined.select(*table.columns, *[F.when(F.col("sig").isNotNull(), F.col(c)).alias(c) for c in said])


def join_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when 100 * |intersection| >= percent * |union|.
    """
    table, named = _classes(docs, width, percent)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return _with_classes(table, named.join(least, "root").select("node", "component")).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def clustered(docs: DataFrame, carry: Column, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, carried (the value of ``carry``), words, cluster.

    The cluster is named by the signature of a member of the document's
    component; null for a document without words.
    """
    table, named = _classes(docs, width, percent, carry)
    return _with_classes(table, named.select("node", "root")).select("doc_id", "carried", "words", F.coalesce("root", "own").alias("cluster"))


def kept_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each component: that of the smallest id (rows
    without an id come last), of rows with one id that of the smallest hash of the text.

    Rows are told apart by id and text, so a row goes only if its own text has
    a partner that stays; rows that repeat both id and text stay or go together.
    """
    content = F.concat_ws("-", F.xxhash64(F.coalesce("text", F.lit(""))).cast("string"), F.octet_length("text").cast("string"))
    table, named = _classes(docs, width, percent, content)
    members = table.join(named.select(F.col("node").alias("sig"), "root"), "sig")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "carried")
    best = members.groupBy("root").agg(F.min(row).alias("best"))
    gone = members.join(best, "root").filter(row != F.col("best")).select(F.col("doc_id").alias("gone_id"), F.col("carried").alias("gone_text")).distinct()
    rows = docs.select(F.struct("*").alias("kept_row"), F.col("doc_id").cast("long").alias("row_id"), content.alias("row_text"))
    left = rows.join(gone, F.col("row_id").eqNullSafe(F.col("gone_id")) & (F.col("row_text") == F.col("gone_text")), "left_anti")
    return left.select("kept_row.*")
