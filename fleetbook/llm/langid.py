"""Language identification with interpolated Kneser-Ney character models.

Each language has a 4-gram model over lower-cased letters, every run of other
characters being one space. Counts come from whole texts of labelled documents;
the model keeps, for each order, a sorted array of n-gram keys (four 16-bit
symbols in 64 bits) with discounted probabilities, and a sorted array of
context keys with interpolation weights. A text goes to the language of the
lowest cross-entropy per symbol; it is rejected when that exceeds the language's
limit for its length (``limits_of``), learned from all held back training texts.

Sampling: the models are fitted on at most about ``docs_per_lang`` labelled
documents of each language (a hash threshold on the id chosen from the
language's count; expected size, whole texts); a further tenth as many calibrate
rejection (one row each to the driver). Everything else covers all rows. The number
of languages is assumed to be small (a model each); the model's size is bounded by
the sample.

Defined cases: null text, empty text and text without a letter give ``und``
with score 0; without labelled documents every prediction is ``und``; without a held
back text in any language only texts without a letter are rejected. Repeated
rows give repeated results. Only id, text and lang are read by
``train`` and id and text by ``predict``; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import MULT, id_text, run_starts, small_batches

ORDER, SPACE = 4, 32
_CHUNK = 1 << 18

#: Symbols from which on a text can be rejected for its cross-entropy.
LEAST = 32
#: Rejection: share of held back texts below the margin, the margin at least, and
#: standard deviations of a text's cross-entropy at its length.
QUANTILE, MARGIN, DEVIATIONS = 0.99, 0.3, 4.0
#: Held back texts from which on a language has a median of its own.
FEW = 5


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), dtype=bool, count=1 << 16)


def symbols(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram keys of all texts, the offsets of each text's keys, and whether it has a letter."""
    low = [(t or "").lower() for t in texts]
    starts = run_starts(np.fromiter(map(len, low), dtype=np.int64, count=len(low)))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    basic = codes < 1 << 16
    is_letter = letters[np.where(basic, codes, 0)]
    for c in np.unique(codes[~basic]):
        is_letter[codes == c] = chr(c).isalpha()
    sym = np.where(is_letter, codes & 0xFFFF, SPACE).astype(np.uint64)
    first = np.zeros(len(codes), dtype=bool)
    first[starts[:-1][starts[:-1] < len(codes)]] = True
    before = np.zeros(len(codes), dtype=bool)
    before[1:] = is_letter[:-1]
    keep = is_letter | before | first
    kept = run_starts(keep.astype(np.int64))
    starts, any_letter = kept[starts], np.diff(run_starts(is_letter.astype(np.int64))[starts]) > 0
    sym = sym[keep]
    place = np.arange(len(sym)) - np.repeat(starts[:-1], np.diff(starts))
    key = sym.copy()
    for back in range(1, ORDER):
        prev = np.full(len(sym), SPACE, dtype=np.uint64)
        prev[back:] = sym[:-back] if back < len(sym) else prev[back:]
        prev[place < back] = SPACE
        key |= prev << np.uint64(16 * back)
    return key, starts, any_letter


class CharModel:
    """Sorted hash arrays of one language's interpolated Kneser-Ney model."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, base: float):
        """``keys`` sorted, distinct 4-grams; ``base``: probability of an unseen symbol's place."""
        self.base, self.orders = base, []
        for n in range(ORDER, 0, -1):
            ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
            discount = min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))
            context, first = np.unique(keys >> np.uint64(16), return_index=True)
            total = np.add.reduceat(counts, first) if len(keys) else counts
            kinds = np.diff(np.append(first, len(keys)))
            owner = np.repeat(np.arange(len(context)), kinds)
            prob = np.maximum(counts - discount, 0) / total[owner] if len(keys) else counts.astype(float)
            self.orders.append((n, keys, prob, context, discount * kinds / np.maximum(total, 1)))
            # the next order counts the distinct symbols before each shorter n-gram
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True)
        self.orders.reverse()

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """log2 P(last symbol | three before) of each 4-gram."""

        def look(table, values, wanted, missing):
            if not len(table):
                return np.full(len(wanted), missing)
            at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
            return np.where(table[at] == wanted, values[at], missing)

        p = np.full(len(grams), self.base)
        for n, keys, prob, context, weight in self.orders:
            k = grams & np.uint64((1 << 16 * n) - 1)
            p = look(keys, prob, k, 0.0) + look(context, weight, k >> np.uint64(16), 1.0) * p
        return np.log2(p)


class Models:
    """The models of all languages and their rejection limits."""

    def __init__(self, langs: list[str], models: list[CharModel], limits: dict[str, tuple[float, float]] | None = None):
        self.langs, self.models, self.limits = langs, models, limits or {}

    def plain(self) -> tuple:
        """Lists and arrays only, for a broadcast."""
        return self.langs, [(m.base, m.orders) for m in self.models], self.limits

    @classmethod
    def of_plain(cls, parts: tuple) -> "Models":
        langs, models, limits = parts
        made = []
        for base, orders in models:
            made.append(m := CharModel.__new__(CharModel))
            m.base, m.orders = base, orders
        return cls(langs, made, limits)

    def scorer(self, slots: int = 1 << 18):
        """A function from texts to (cross-entropies, lengths, has a letter).

        A direct-mapped table keeps the log probabilities of 4-grams met
        before; it changes speed only.
        """
        letters = letter_table()
        shift = np.uint64(64 - (slots.bit_length() - 1))
        tags, held = np.zeros(slots, dtype=np.uint64), np.zeros((slots, len(self.models)))

        def look(key):
            slot = ((key * MULT) >> shift).astype(np.int64)
            out, miss = held[slot], tags[slot] != key
            if miss.any():
                new = np.unique(key[miss])
                got = np.stack([m.log2(new) for m in self.models], axis=1)
                out[miss] = got[np.searchsorted(new, key[miss])]
                at = ((new * MULT) >> shift).astype(np.int64)
                # of keys that share a slot the last one stays, with its own values
                _, last = np.unique(at[::-1], return_index=True)
                pick = len(new) - 1 - last
                tags[at[pick]], held[at[pick]] = new[pick], got[pick]
            return out

        def score(texts):
            key, starts, has = symbols(texts, letters)
            n = np.diff(starts)
            sums = np.zeros((len(texts), len(self.models)))
            if len(key) and self.models:
                full = n > 0
                sums[full] = np.add.reduceat(look(key), starts[:-1][full], axis=0)
            return -sums / np.maximum(n, 1)[:, None], n, has

        return score

    def judge(self, entropy: np.ndarray, n: np.ndarray, has: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.models:
            return ["und"] * len(n), np.zeros(len(n)), np.ones(len(n), dtype=bool)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(n)), best]
        odds = np.exp2(-(entropy - low[:, None]) * np.minimum(n, 64)[:, None]).sum(axis=1)
        lang = [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
        level, spread = np.array([self.limits.get(x, (np.inf, 0.0)) for x in self.langs])[best].T
        return lang, np.where(has, 1 / odds, 0.0), ~has | ((low > level + spread / np.sqrt(np.maximum(n, 1))) & (n >= LEAST))


def limits_of(langs: list[str], nearest: np.ndarray, entropy: np.ndarray, size: np.ndarray) -> dict[str, tuple[float, float]]:
    """Each language's (level, spread): a text of n symbols may have level + spread / sqrt(n).

    From held back texts of all languages: the place of the language that is nearest
    to each, the cross-entropy under it, and the length. Excesses are relative to the
    median of the language and pooled, so a language with few texts has the others'
    margin, and one without a median of its own the highest median. The spread is
    robust (a median), and the level clears the quantile of what it leaves over.
    """
    if not len(entropy):
        return {}
    own = [float(np.median(entropy[nearest == k])) if (nearest == k).sum() >= FEW else None for k in range(len(langs))]
    known = [x for x in own if x is not None] or [float(np.median(entropy))]
    centre = np.maximum(np.array([max(known) if x is None else x for x in own]), 1e-9)
    excess = entropy / centre[nearest] - 1
    spread = DEVIATIONS * 1.4826 * float(np.median(np.abs(excess) * np.sqrt(size)))
    margin = max(MARGIN, float(np.quantile(excess - spread / np.sqrt(size), QUANTILE)))
    return {x: (float(c * (1 + margin)), float(c * spread)) for x, c in zip(langs, centre, strict=True)}


def _chunks(batch: pa.RecordBatch, column: int):
    """Row ranges of a batch of about _CHUNK characters."""
    begin, size = 0, 0
    lengths = [0 if t is None else len(t) for t in batch.column(column).to_pylist()]
    for i, n in enumerate(lengths):
        size += n
        if size >= _CHUNK:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < len(lengths):
        yield batch.slice(begin)


def train(docs: DataFrame, learn: Column, docs_per_lang: int = 2000) -> Models:
    """Fit the models on rows of (doc_id, text, lang) for which ``learn`` holds."""
    spark = docs.sparkSession
    known = small_batches(docs).filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return Models([], [])
    langs = sorted(per)
    space = 1_000_000
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(space, -(-docs_per_lang * space // per[k]))))])
    draw = F.pmod(F.xxhash64(id_text("doc_id")), F.lit(space))
    part = F.when(draw < share[F.col("lang")] * 0.9, 0).when(draw < share[F.col("lang")], 1)
    sample = known.withColumn("part", part).filter("part is not null").select("lang", "part", "text")

    def count(batches):
        letters = letter_table()
        for batch in batches:
            for piece in _chunks(batch, 1):
                lang, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                for one in sorted(set(lang)):
                    key, _, _ = symbols([t for x, t in zip(lang, texts, strict=True) if x == one], letters)
                    k, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams = sample.filter("part = 0").select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.toArrow()
    lang, key, n = np.array(table["lang"].to_pylist(), dtype=object), table["gram"].to_numpy().astype(np.int64).view(np.uint64), table["n"].to_numpy()
    seen = len(np.unique(key & np.uint64(0xFFFF))) + 1
    models = []
    for one in langs:
        k, c = key[lang == one], n[lang == one]
        order = np.argsort(k)
        models.append(CharModel(k[order], c[order].astype(np.int64), 1.0 / seen))
    fitted = spark.sparkContext.broadcast(Models(langs, models).plain())

    def calibrate(batches):
        score = Models.of_plain(fitted.value).scorer()
        for batch in batches:
            for piece in _chunks(batch, 0):
                entropy, size, has = score(piece.column(0).to_pylist())
                ok = has & (size >= LEAST)
                yield pa.RecordBatch.from_arrays([pa.array(entropy.argmin(axis=1)[ok]), pa.array(entropy.min(axis=1)[ok]), pa.array(size[ok])], ["nearest", "entropy", "size"])

    # a bounded sample; sorted, as float results depend on the order
    held = sample.filter("part = 1").select("text").mapInArrow(calibrate, "nearest long, entropy double, size long").toArrow().sort_by([(c, "ascending") for c in ("nearest", "entropy", "size")])
    return Models(langs, models, limits_of(langs, *(held[c].to_numpy() for c in ("nearest", "entropy", "size"))))


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models.plain())

    def run(batches):
        held = Models.of_plain(shared.value)
        score = held.scorer()
        for batch in batches:
            for piece in _chunks(batch, 1):
                lang, sure, out = held.judge(*score(piece.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = small_batches(docs).select("doc_id", "text")
    schema = StructType([rows.schema["doc_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return rows.mapInArrow(run, schema)


def accepted_rows(docs: DataFrame, models: Models) -> DataFrame:
    """The rows whose text is not rejected, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(models.plain())
    at = docs.columns.index("text")

    def run(batches):
        held = Models.of_plain(shared.value)
        score = held.scorer()
        for batch in batches:
            for piece in _chunks(batch, at):
                _, _, out = held.judge(*score(piece.column(at).to_pylist()))
                yield piece.filter(pa.array(~out))

    return small_batches(docs).mapInArrow(run, docs.schema)
