"""Conflict-constrained best-fit packing of documents into fixed-length bins.

Documents are cut into pieces of at most ``capacity`` words; full pieces fill
bins of their own, and the last pieces are packed by best-fit decreasing. A bin
may hold each duplicate cluster once and each source ``per_source`` times: it
carries a bitmap of its clusters and one bitmap of its sources for each time.
Open bins are kept in order of residual space; the search for a piece begins at
the successor of its size and goes on to the next larger residual until a bin
without a conflict is found, which is the tightest compatible one.

Documents are dealt by a hash of the id and content into shards of about
``shard_rows`` rows, each packed in one task, so no source or cluster meets in one
task; a shard leaves only its last bins part-filled. Bitmaps number the sources
and clusters of a shard exactly: bits are never shared.

A cluster is given by a column, or else it is a document's component in the n-gram
Jaccard join (``ngram_join``), named by a 64-bit hash of a member's word 5-grams;
a document that stands alone is a cluster of its own.
Defined cases: null, empty and blank texts have no words, get no bin (bin_id
null, pieces 0); a null cluster conflicts with nothing; a null source is a
source of its own; repeated rows share a cluster, so they never share a bin;
very long texts are cut like all others; an empty table gives no rows; other
columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, staged
from .ngram_join import clustered

#: Words of a bin, documents of one source in a bin, rows of a shard.
CAPACITY, PER_SOURCE, SHARD_ROWS = 2048, 2, 8192


def sizes_and_clusters(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, source, size, cluster): words of each text, and its component of near copies.

    The n-gram join, which has read every text, hands over words, source and cluster of
    each row, so ids may be missing or repeated.
    """
    return clustered(docs, F.col("source"), width, percent).select("doc_id", F.col("carried").alias("source"), F.col("words").alias("size"), "cluster")


class Bins:
    """Open bins in order of residual space, with their bitmaps."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def compatible(self, number: int, source: int, cluster: int) -> bool:
        return not (cluster & self.clusters[number]) and not (source & self.sources[number][-1])

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece; ``source`` and ``cluster`` are single bits (0: no cluster)."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order) and not self.compatible(self.order[at][1], source, cluster):
            at += 1
        if at < len(self.order):
            residual, number = self.order.pop(at)
        else:
            residual, number = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        self.clusters[number] |= cluster
        for k, plane in enumerate(self.sources[number]):
            if not plane & source:
                self.sources[number][k] |= source
                break
        if residual > size:
            insort(self.order, (residual - size, number))
        return number, self.capacity - residual


def pack_rows(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[tuple[int | None, int | None, int]]:
    """(bin of the last piece, offset in it, full bins) of each row, in the rows' order.

    Bins are numbered from 0 in the order in which they are opened; full bins have no number here.
    """
    bins, out = Bins(capacity, per_source), [None] * len(sizes)
    bit_s: dict = {}
    bit_c: dict = {}
    for i in sorted(range(len(sizes)), key=lambda i: -(sizes[i] % capacity)):
        full, last = divmod(sizes[i], capacity)
        if last:
            s = 1 << bit_s.setdefault(sources[i], len(bit_s))
            c = 0 if clusters[i] is None else 1 << bit_c.setdefault(clusters[i], len(bit_c))
            out[i] = (*bins.put(last, s, c), full)
        else:
            out[i] = (None, None, full)
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack stored rows of (doc_id, source, size, cluster).

    One row per row: doc_id, size, source, cluster, pieces, full_bins, bin_id,
    offset, tail: the first ``full_bins * capacity`` words fill bins of their own,
    the last ``tail`` words lie in ``bin_id`` from ``offset`` on.
    """
    shards = max(1, -(-rows.count() // shard_rows))

    def run(table):
        cols = [table[c].to_pylist() for c in ("doc_id", "cluster", "source", "size")]
        order = sorted(range(table.num_rows), key=lambda i: [(c[i] is None, c[i]) for c in cols])
        table = table.take(pa.array(order, pa.int64()))
        size, shard = table["size"].to_pylist(), table["shard"][0].as_py()
        placed = pack_rows(size, table["source"].to_pylist(), table["cluster"].to_pylist(), capacity, per_source)
        return pa.table({
            "doc_id": table["doc_id"], "source": table["source"], "size": table["size"], "cluster": table["cluster"], "pieces": pa.array([-(-n // capacity) for n in size], pa.int64()), "full_bins": pa.array([p[2] for p in placed], pa.int64()),
            "bin_id": pa.array([None if p[0] is None else f"{shard}-{p[0]}" for p in placed], pa.string()), "offset": pa.array([p[1] for p in placed], pa.int64()), "tail": pa.array([n % capacity for n in size], pa.int64()),
        })

    salted = rows.withColumn("shard", F.pmod(F.xxhash64(id_text("doc_id"), "cluster", "size", "source"), F.lit(shards)).cast("int"))
    return salted.groupBy("shard").applyInArrow(run, "doc_id long, source string, size long, cluster long, pieces long, full_bins long, bin_id string, offset long, tail long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """Pack all documents by their words; see ``pack``."""
    return pack(staged(sizes_and_clusters(docs), "pack-sizes"), capacity, per_source)
