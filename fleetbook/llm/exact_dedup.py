"""Exact dedup with counting quotient filters.

Each partition puts the 64-bit fingerprints of its normalised texts into a
counting quotient filter: the high bits (quotient) name a home slot, the low
bits (remainder) are stored, sorted, in runs found through two bit vectors,
and each slot has a counter. A filter is cut by quotient range; the pieces of
one range from all partitions are merged without loss, by sorted quotient and
remainder. Fingerprints counted once need nothing more. Rows whose fingerprint
is counted more than once go to byte verification: they are grouped by the
whole normalised text.

Defined cases: a null text counts as empty; of rows with equal texts and
lengths the smallest doc_id stays, a null doc_id after all others; repeated
rows (same doc_id, same text) share one verdict, and ``kept_rows`` returns one
of them. Columns of the input other than the id and the text are never read by
name, so they may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SPACES, shuffle_width, small_batches, staged

_DROP = SPACES.encode()


class CountingQuotientFilter:
    """Fingerprints of ``q + r`` bits with counts, in quotient-filter layout.

    ``occupied`` has a bit for each quotient that has a run, ``run_end`` a bit
    for each slot that ends a run; ``remainder`` and ``count`` are the used
    slots in order. Slots follow linear probing, so a run may be shifted.
    """

    def __init__(self, q: int, r: int, quotient: np.ndarray, remainder: np.ndarray, count: np.ndarray):
        """Entries sorted by (quotient, remainder), each pair once."""
        self.q, self.r, self.remainder, self.count = q, r, remainder.astype(np.uint64), count.astype(np.int64)
        n = len(quotient)
        home = quotient.astype(np.int64)
        order = np.arange(n)
        slot = np.maximum.accumulate(home - order) + order if n else home
        last = np.append(home[1:] != home[:-1], True) if n else np.zeros(0, bool)
        occupied = np.zeros(1 << q, dtype=bool)
        occupied[home] = True
        run_end = np.zeros(max(1 << q, int(slot[-1]) + 1 if n else 0), dtype=bool)
        run_end[slot[last]] = True
        used = np.zeros(len(run_end), dtype=bool)
        used[slot] = True
        self.occupied, self.run_end, self.used = np.packbits(occupied), np.packbits(run_end), np.packbits(used)

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> "CountingQuotientFilter":
        """From sorted distinct fingerprints of ``bits`` bits."""
        q = max(1, int(np.ceil(np.log2(max(1, len(values)) / 0.75))))
        r = bits - q
        return cls(q, r, values >> np.uint64(r), values & np.uint64((1 << r) - 1), counts)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, sorted, and their counts."""
        homes = np.flatnonzero(np.unpackbits(self.occupied))
        used = np.flatnonzero(np.unpackbits(self.used))
        ends = np.searchsorted(used, np.flatnonzero(np.unpackbits(self.run_end)))
        quotient = np.repeat(homes, np.diff(np.append(-1, ends))).astype(np.uint64)
        return (quotient << np.uint64(self.r)) | self.remainder, self.count

    def to_row(self) -> dict:
        wide = self.r > 32
        return {
            "q": self.q, "r": self.r, "occupied": self.occupied.tobytes(), "run_end": self.run_end.tobytes(), "used": self.used.tobytes(),
            "remainder": (self.remainder if wide else self.remainder.astype(np.uint32)).tobytes(), "n": len(self.count),
            "extra": np.flatnonzero(self.count > 1).astype(np.uint32).tobytes(), "extra_count": self.count[self.count > 1].tobytes(),
        }

    @classmethod
    def from_row(cls, row: dict) -> "CountingQuotientFilter":
        self = cls.__new__(cls)
        self.q, self.r = row["q"], row["r"]
        for k in ("occupied", "run_end", "used"):
            setattr(self, k, np.frombuffer(row[k], dtype=np.uint8))
        self.remainder = np.frombuffer(row["remainder"], dtype=np.uint64 if self.r > 32 else np.uint32).astype(np.uint64)
        self.count = np.ones(row["n"], dtype=np.int64)
        self.count[np.frombuffer(row["extra"], dtype=np.uint32)] = np.frombuffer(row["extra_count"], dtype=np.int64)
        return self


def merge(filters: list[CountingQuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
    """All entries of filters over one range, sorted, counts added up."""
    parts = [f.entries() for f in filters]
    values, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(values) else counts


_FILTER = "range int, q int, r int, n int, occupied binary, run_end binary, used binary, remainder binary, extra binary, extra_count binary"


def repeated_fingerprints(fps: DataFrame, rows: int, per_range: int = 1 << 20) -> DataFrame:
    """(fp) of the fingerprints in column ``fp`` that occur more than once.

    A merge holds one range: about ``per_range`` fingerprints, whatever the
    number of rows.
    """
    width = max(shuffle_width(fps.sparkSession), -(-rows // per_range))
    bits = int(np.ceil(np.log2(max(2, width))))
    schema = pa.schema([("range", pa.int32()), ("q", pa.int32()), ("r", pa.int32()), ("n", pa.int32()), *((k, pa.binary()) for k in ("occupied", "run_end", "used", "remainder", "extra", "extra_count"))])

    def build(batches):
        def filters(values, counts):
            piece = (values >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(values)), strict=True):
                low = values[a:b] & np.uint64((1 << (64 - bits)) - 1)
                yield {"range": int(piece[a]), **CountingQuotientFilter.of(low, counts[a:b], 64 - bits).to_row()}

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += len(held[-1])
            if size >= 1 << 22:
                yield pa.RecordBatch.from_pylist(list(filters(*np.unique(np.concatenate(held), return_counts=True))), schema=schema)
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_pylist(list(filters(*np.unique(np.concatenate(held), return_counts=True))), schema=schema)

    def united(table):
        rows = table.to_pylist()
        values, counts = merge([CountingQuotientFilter.from_row(x) for x in rows])
        high = np.uint64(rows[0]["range"] << (64 - bits))
        return pa.table({"fp": (values[counts > 1] | high).view(np.int64)})

    return fps.select("fp").mapInArrow(build, _FILTER).groupBy("range").applyInArrow(united, "fp long")


def _measured(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The whole row as ``row``, and its id, fingerprint, digest and length."""

    def measure(batches):
        for batch in batches:
            row = batch.column(0)
            fp, sha, cp = [], [], []
            for t in row.field(text_col).to_pylist():
                t = t or ""
                norm = t.encode().translate(None, _DROP)
                fp.append(xxhash.xxh3_64_intdigest(norm) - (1 << 63))
                sha.append(hashlib.sha256(norm).hexdigest())
                cp.append(len(t))
            yield pa.RecordBatch.from_arrays([row, pa.array(fp, pa.int64()), pa.array(sha, pa.string()), pa.array(cp, pa.int64())], ["row", "fp", "sha", "cp"])

    rows = docs.select(F.struct("*").alias("row"))
    schema = StructType([*rows.schema.fields, StructField("fp", LongType()), StructField("sha", StringType()), StructField("cp", LongType())])
    return small_batches(rows).mapInArrow(measure, schema).withColumn("id", F.col("row")[id_col])


def _norm(text_col: str):
    return F.translate(F.coalesce(F.col("row")[text_col], F.lit("")), SPACES, "")


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _measured(docs.select(id_col, text_col), text_col, id_col)
    table = staged(rows.select("id", "fp", "sha", "cp"), "exact-digests")
    again = staged(repeated_fingerprints(table, table.count()), "exact-repeats")
    groups = (
        rows.join(again, "fp", "left_semi")
        .groupBy("fp", _norm(text_col).alias("norm"))
        .agg(F.count("*").alias("size"), F.max(F.struct("cp", -F.col("id"))).alias("best"), F.min("sha").alias("sha"))
        .select("fp", "sha", "size", (-F.col("best")["col2"]).alias("keep"))
    )
    joined = table.join(groups, ["fp", "sha"], "left")
    single = F.col("size").isNull()
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, one for each distinct normalised text, unchanged."""
    rows = _measured(docs, text_col, id_col)
    table = staged(rows.select("fp"), "exact-digests")
    again = staged(repeated_fingerprints(table, table.count()).withColumn("again", F.lit(True)), "exact-repeats")
    marked = rows.join(again, "fp", "left")
    winners = (
        marked.filter("again")
        .groupBy("fp", _norm(text_col).alias("norm"))
        .agg(F.max_by("row", F.struct("cp", -F.col("id"), F.col("row")[text_col])).alias("row"))
        .select("row")
    )
    return marked.filter(F.col("again").isNull()).select("row").unionByName(winners).select("row.*")
