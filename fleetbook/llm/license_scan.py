"""License scans: base phrases and fuzzy search for short notices.

Texts are read as words: runs of digits, a-z and non-ASCII characters after
lower-casing A-Z. A base phrase is found where its words stand consecutively.
A notice of ``n`` characters is found within ``errors`` edits (insertions,
deletions, substitutions): it is cut into ``errors + 1`` pieces, one of which
must occur exactly (pigeonhole); every exact occurrence of a piece gives a
window, and the regex library's bounded-error matching verifies the window and
gives the span and the number of edits. A span counts when the words that tell
licences apart (``MARKS`` and version numbers) stand in it exactly.

Each row is scanned whole and on its own, without a shuffle.

Defined cases: a null text counts as empty (no words, no places, empty labels,
score 0, no spans); a very long text is one string of a task's batch; repeated
rows give repeated results. Only id and text are read, so other columns may
have any name.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

#: Phrases that give base labels.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Short notices by label, as words.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("reserved", "all rights reserved"),
)

#: Words of notices that stand exactly in a span, as another licence may be few edits away.
MARKS = frozenset(("mit", "apache", "cc", "by", "nc", "nd", "sa", "gnu", "lesser", "mozilla"))

_WORD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def allowed_errors(notice: str) -> int:
    """One edit for every twelve characters, one at least."""
    return max(1, len(notice) // 12)


class Notice:
    """A notice with its exact seeds and its verifier."""

    def __init__(self, label: str, text: str, errors: int | None = None):
        self.label, self.text = label, text
        self.errors = allowed_errors(text) if errors is None else errors
        cuts = [round(k * len(text) / (self.errors + 1)) for k in range(self.errors + 2)]
        self.marks = [w for w in text.split() if w in MARKS]
        self.numbers = [w.encode() for w in text.split() if w.isdigit()]
        self.seeds = [(a, text[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={self.errors}}}")

    def marked(self, words: list[bytes]) -> bool:
        """Whether a span's words hold the notice's marks in order, and its version number.

        A version may be cut short (2 for 2.0), but has no other number in it.
        """
        rest = iter(words)
        if not all(m.encode() in rest for m in self.marks):
            return False
        numbers = [w for w in words if w.isdigit()]
        return not self.numbers or (bool(numbers) and numbers == self.numbers[: len(numbers)])

    def search(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches in normalised bytes, in order."""
        size = len(self.text)
        near = 4 * self.errors  # bytes of as many characters
        starts = set()
        for offset, seed in self.seeds:
            at = data.find(seed)
            while at >= 0:
                starts.add(max(0, at - offset))
                at = data.find(seed, at + 1)
        found, end = {}, -1
        for start in sorted(starts):
            if start < end:  # inside a match already verified
                continue
            low = max(0, start - near)
            window = data[low : start + size + 2 * near].decode("utf-8", "replace")
            m = self.pattern.search(window)
            if m is None:
                continue
            a = low + len(window[: m.start()].encode()) if window.isascii() is False else low + m.start()
            b = a + len(m[0].encode())
            edits = sum(m.fuzzy_counts)
            held = found.get(a)
            if held is None or edits < held[1]:
                found[a] = (b, edits)
            if edits == 0:
                end = b - size // (self.errors + 1)
        return [(a, b, e) for a, (b, e) in sorted(found.items())]


def normalise(text: str | None) -> tuple[bytes, int]:
    """Words joined by single spaces, with one before and after, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" " if words else b" ", len(words)


def places(data: bytes, phrase: str) -> list[int]:
    """Byte offsets of the space before each place of the phrase."""
    needle, out = f" {phrase} ".encode(), []
    at = data.find(needle)
    while at >= 0:
        out.append(at)
        at = data.find(needle, at + 1)
    return out


def scan_text(text: str | None, base: dict[str, str], notices: list[Notice]) -> dict:
    """All that the scan says of one text."""
    data, n_words = normalise(text)
    hits = {label: places(data, phrase) for label, phrase in base.items()}
    where = [at for x in hits.values() for at in x]
    base_labels = sorted(label for label, x in hits.items() if x)
    spans, score = [], 1.0 if where else 0.0
    for notice in notices:
        for a, b, edits in notice.search(data):
            # whole words, also where the span ends within one
            low = data.rfind(b" ", 0, a + 1) + 1
            high = data.find(b" ", max(a + 1, b - 1))
            if not notice.marked(data[low : high if high >= 0 else len(data)].split()):
                continue
            spans.append({"label": notice.label, "first_word": data.count(b" ", 1, a + 1), "last_word": data.count(b" ", 1, max(a + 1, b - 1)), "edits": edits})
            score = max(score, 1.0 - edits / len(notice.text))
    return {
        "n_words": n_words, "n_base": len(where), "first_word": data.count(b" ", 0, min(where)) if where else None, "last_word": data.count(b" ", 0, max(where)) if where else None,
        "base_labels": ",".join(base_labels), "labels": ",".join(sorted({*base_labels, *(s["label"] for s in spans)})), "score": score, "spans": spans,
    }


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: tuple = NOTICES) -> DataFrame:
    """One row per document: word count, base places and labels, labels, score and fuzzy spans."""

    def run(batches):
        ready = [Notice(label, text) for label, text in notices]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = [{"doc_id": i, **scan_text(t.as_py(), base, ready)} for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return small_batches(docs).selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, _SCHEMA)
