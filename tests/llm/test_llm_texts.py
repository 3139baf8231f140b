"""Mixing, chat formatting, packing, licence scans and WARC bundles."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetbook.llm import chat, license_scan, mixing, packing, warc
from fleetbook.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


# --- mixing ----------------------------------------------------------------------------------

def brute_targets(sizes, epochs=3):
    """Reshare the excess by weight until no target is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rate = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if rate * weight[s] > epochs * sizes[s]]
        if not over:
            return fixed | {s: rate * weight[s] for s in free}
        fixed |= {s: epochs * sizes[s] for s in over}


def mixed(df):
    return sorted(map(tuple, mixing.mix(df).collect()), key=repr)


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(k, "w " * rnd.randint(0, 400), rnd.choice(["a"] * 6 + ["b", "c", "d", None])) for k in range(400)]
    rows += [(1000, None, "e"), (1001, "", "a"), (1001, "", "a"), (None, "x y z", "b"), (7, rows[7][1], rows[7][2]), (2000, "long " * 9000, "f")]
    df = docs_of(spark, rows).selectExpr("*", "1 as place", "2 as size", "3 as row")
    got = mixed(df)
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = brute_targets(sizes)
    by = {}
    assert sorted((g[0], g[1]) for g in got if g[0] is not None) == sorted((i, len((t or "").split())) for i, t, _ in rows if i is not None)
    for _, size, source_size, want, taken in got:
        assert 0 <= taken <= 3 * size
        by.setdefault((source_size, round(want, 6)), []).append(taken)
    assert {k: round(v, 6) for k, v in target.items()}.keys() == sizes.keys()
    for s, v in target.items():
        assert (sizes[s], round(v, 6)) in by
    for (source_size, want), taken in by.items():
        same = [s for s in sizes if sizes[s] == source_size and round(target[s], 6) == want]
        block = mixing.block_length(sum(sizes.values()))
        assert abs(sum(taken) - want * len(same)) <= 4 * block * len(same) + 1
    assert mixed(df) == got  # reruns agree
    assert mixing.mix(df.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect())


def test_mixed_rows_follow_the_mix(spark):
    rnd = random.Random(5)
    rows = [(k, "w " * rnd.randint(0, 60), rnd.choice("abc")) for k in range(120)]
    df = docs_of(spark, rows).selectExpr("*", "1 as copies")
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    for r in mixing.mix(df).collect():
        assert n.get(r.doc_id, 0) == (int(r.taken / r.size + 0.5) if r.size else 0)


# --- chat ------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\im_start>\n ab"))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    role = chat.escape_role(text)
    assert chat.unescape_role(role) == text and "\n" not in role and "<|" not in role


CONV = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        form = "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n" for r, t in turns)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((c, len(turns), sha(whole), len(loss), sha(loss), len(form)))
    return sorted(out, key=repr)


CHAT_ROWS = [(c, k, ("system", "user", "assistant", "user", "assistant")[k], ("same start", "hi", f"answer {c % 3}", "é <|im_end|>", f"x{c}" * 50)[k])
             for c in range(30) for k in range(5 - c % 3)]
CHAT_ROWS += [(50, 0, None, None), (51, None, "assistant", ""), (52, 1, "user", "b"), (52, 1, "user", "a"), (52, 1, "user", "a"), (None, 0, "user", "n"),
              (53, 0, "as\nsistant", "t"), (54, 0, "assistant", "long " * 40_000)]


@pytest.mark.parametrize("pack_chars", [1 << 18, 50])
def test_chat_round_trip(spark, pack_chars):
    df = spark.createDataFrame([(*r, 1) for r in CHAT_ROWS], CONV + ", path_id int").repartition(3)
    packs, members = chat.format_conversations(df, pack_chars)
    got = members.join(chat.read_back(packs), "path_id").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_chat(CHAT_ROWS)


def test_shared_turns_are_emitted_once():
    pack = chat.Pack()
    a = [("user", "hi"), ("assistant", "yes")]
    b = [("user", "hi"), ("assistant", "zzz"), ("user", "more")]
    pack.add(1, a, 0)
    pack.add(2, b, 1)
    row = pack.row()
    assert row["stream"].count("user\nhi") == 1
    first, yes, no, more = row["nodes"]
    assert yes["ancestors"] == [{"start": 0, "end": first["end"]}] and no["ancestors"] == yes["ancestors"]
    assert more["ancestors"] == [{"start": 0, "end": first["end"]}, {"start": no["start"], "end": no["end"]}]
    assert no["position"] == yes["position"] == first["end"] and more["position"] == first["end"] + no["end"] - no["start"]
    assert row["stream"][no["loss_start"]:no["loss_end"]] == "zzz" and more["loss_start"] is None


def test_chat_of_nothing(spark):
    assert chat.format_and_read(spark.createDataFrame([], CONV)).count() == 0


# --- packing ---------------------------------------------------------------------------------

def brute_pack(sizes, sources, clusters, capacity, per_source):
    """Best-fit decreasing by trying every bin."""
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -(sizes[i] % capacity)):
        last = sizes[i] % capacity
        if not last:
            out[i] = (None, None, sizes[i] // capacity)
            continue
        fits = [(capacity - used, k) for k, (used, s, c) in enumerate(bins) if used + last <= capacity
                and (clusters[i] is None or clusters[i] not in c) and s.count(sources[i]) < per_source]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([0, [], []])
        out[i] = (k, bins[k][0], sizes[i] // capacity)
        bins[k][0] += last
        bins[k][1].append(sources[i])
        bins[k][2].append(clusters[i])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 45), st.sampled_from(["a", "b", None]), st.sampled_from([None, 1, 2, 3])), max_size=40), st.integers(1, 3))
def test_packing_matches_brute_force(rows, per_source):
    sizes, sources, clusters = ([r[k] for r in rows] for k in range(3))
    assert packing.pack_rows(sizes, sources, clusters, 20, per_source) == brute_pack(sizes, sources, clusters, 20, per_source)


def test_pack_documents(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randint(0, 50))), rnd.choice("aab")) for k in range(300)]
    rows += [(400 + k, "the very same text " * 3, "a") for k in range(20)] + [(1, rows[1][1], None), (None, "x", "b"), (500, None, "a"), (501, " ", "a"), (502, "w " * 5000, None)]
    df = docs_of(spark, rows).selectExpr("*", "1 as cluster", "2 as shard", "3 as size")
    got = packing.pack_documents(df, capacity=64).collect()
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((i, len((t or "").split())) for i, t, _ in rows if i is not None)
    bins = {}
    for r in got:
        assert r.full_bins * 64 + r.tail == r.size and (r.bin_id is None) == (r.tail == 0) and r.pieces == -(-r.size // 64)
        if r.bin_id:
            bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.tail
        assert at <= 64 and len({r.cluster for r in b}) == len(b)
        assert max([r.source for r in b].count(s) for s in {r.source for r in b}) <= packing.PER_SOURCE
    assert len({r.bin_id for r in got if r.doc_id and 400 <= r.doc_id < 420}) == 20
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_near_copies_never_share_a_bin(spark):
    rnd = random.Random(8)
    rows = []
    for pair in range(60):
        first = [f"p{pair}w{k}" for k in range(200)]
        for k in (0, 1):
            words = list(first)
            if k:
                at = rnd.randrange(10, 180)
                words[at:at + 12] = [f"p{pair}x{j}" for j in range(12)]  # 16 of 196 shingles: J = 180 / 212
            rows.append((None if pair % 10 == 0 else 2 * pair + k, " ".join(words), "abcdefgh"[rnd.randrange(8)]))
    rows += [(5000 + k, f"alone{k} " * 3, "z") for k in range(10)] + [(7, "another text under a used id", "a")]
    of_pair = {}
    got = packing.pack_documents(docs_of(spark, rows), capacity=2048, per_source=50).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len(t.split())) for i, t, _ in rows)
    for r in got:
        if r.size == 200 and r.doc_id is not None:
            of_pair.setdefault(r.doc_id // 2, []).append((r.cluster, r.bin_id))
    assert len(of_pair) == 54 and all(len({c for c, _ in x}) == 1 and len({b for _, b in x}) == 2 for x in of_pair.values())
    lone = [r.cluster for r in got if r.doc_id is None]
    assert len(lone) == 12 and len(set(lone)) == 6  # near copies without an id
    assert len({r.cluster for r in got}) == 60 + 10 + 1


# --- licence scans -----------------------------------------------------------------------------

def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


LICENCES = ["Under the MIT License. under THE mit-license under the mit license", "Apache License, Version 2.0 and CC BY-NC 4.0", "", None, "é under the mit licenseé",
            "cc by nc cc by nc", "under the mit license " * 4000, "no notice here", "xunder the mit license"]


def test_base_places():
    ready = [license_scan.Notice(a, b) for a, b in license_scan.NOTICES]
    for text in LICENCES:
        w, got = words(text), license_scan.scan_text(text, license_scan.BASE, ready)
        places = {a: [k for k in range(len(w)) if w[k:k + len(p.split())] == p.split()] for a, p in license_scan.BASE.items()}
        every = sorted(k for x in places.values() for k in x)
        assert (got["n_words"], got["n_base"]) == (len(w), len(every))
        assert (got["first_word"], got["last_word"]) == ((every[0], every[-1]) if every else (None, None))
        assert got["base_labels"] == ",".join(sorted(a for a, x in places.items() if x))
        assert set(filter(None, got["base_labels"].split(","))) <= set(filter(None, got["labels"].split(",")))


def edited(rnd, text, n):
    t = list(text)
    for _ in range(n):
        k, c = rnd.randrange(len(t)), rnd.choice("abcxyz")
        kind = rnd.randrange(3)
        t[k:k + 1] = [c] if kind == 0 else [] if kind == 1 else [t[k], c]
    return "".join(t)


def test_fuzzy_notices_are_all_found():
    rnd = random.Random(7)
    for label, text in license_scan.NOTICES:
        notice = license_scan.Notice(label, text)
        for _ in range(25):
            filler = " ".join("".join(rnd.choice("qjzkv") for _ in range(5)) for _ in range(30))
            data = f" {filler} {edited(rnd, text, rnd.randint(0, notice.errors))} {filler} ".encode()
            whole = notice.pattern.search(data.decode())  # brute force: no seeds
            hits = notice.search(data)
            assert bool(hits) == bool(whole) and hits
            assert min(e for _, _, e in hits) == sum(whole.fuzzy_counts)
        assert not notice.search(b" nothing of the kind stands here ")


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under the GNU General Public License, version 2.", "gpl-2"), ("Licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("lisensed under the gnu genral public license version 3", "gpl-3"), ("licensed under cc by nd", ""), ("licensed under cc by nc", "cc-by-nc"),
    ("apache license version 1 1", ""), ("licensed under the apache license version 1 1", ""), ("licensed undr the apache licence version 2 0 see", "apache-2"),
    ("mozilla public license version 1 1", ""), ("mozila mozilla public licens version 2 0", "mpl-2"), ("released under the mpl license", ""), ("relesed under the mit licens", "mit"),
])
def test_licences_a_few_edits_apart(text, labels):
    ready = [license_scan.Notice(a, b) for a, b in license_scan.NOTICES]
    got = license_scan.scan_text(f"before {text} after", license_scan.BASE, ready)
    assert got["labels"] == labels and bool(got["spans"]) == bool(labels) == (got["score"] > 0)


def test_scan(spark):
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(LICENCES)] + [(None, "all rigths reserved", 9), (0, LICENCES[0], 9)], "doc_id long, text string, labels int")
    rows = license_scan.scan(df).collect()
    assert len(rows) == len(LICENCES) + 2
    # two edits in a notice of nineteen characters are one too many
    assert [(r.labels, r.score) for r in rows if r.doc_id is None] == [("", 0.0)]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_scan_whole_query(spark):
    """The base columns of the registered query by a plain reading of all words, and what spans and labels say of each other."""
    import re

    from conftest import SF_SMALL
    from fleetbook.llm.queries import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries()["op8_license_scan"](spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    found = 0
    for r in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(label, k, k + len(p) - 1) for label, phrase in license_scan.BASE.items() for p in [phrase.split()]
                for k in range(len(words)) if words[k:k + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert r.first_word == min((h[1] for h in hits), default=None) and r.last_word == max((h[1] for h in hits), default=None)
        base = sorted({h[0] for h in hits})
        assert r.base_labels == ",".join(base) and r.labels == ",".join(sorted({*base, *(s.label for s in r.spans)}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert all(0 <= s.first_word <= s.last_word < len(words) for s in r.spans)
        found += bool(hits)
    assert found


# --- WARC --------------------------------------------------------------------------------------

PAGES = [(1, "http://a/b c", "x" * 100), (2, None, "x" * 100), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1 " * 30),
         (None, "u", "x" * 100), (8, "u", "big " * 600_000), (9, "u", "big " * 600_000), (1, "http://a/b c", "x" * 100)]


def brute_warc(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(ids) if ids else None
        again = len(b) >= 100 and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_archive(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in PAGES], "page_id long, url string, html string, digest int, bundle int")
    got = warc.archive(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_warc(PAGES)
    assert warc.archive(df.limit(0)).count() == 0


def test_single_records_by_seek(spark):
    df = spark.createDataFrame([(k, f"http://h/{k}", f"page {k} " * (k + 1)) for k in range(200)], "page_id long, url string, html string")
    folder = new_path(spark, "warc-test")
    index = warc.write_bundles(warc.revisits(df), folder, frame_bytes=4096).collect()
    assert len({(r.bundle, r.frame) for r in index}) > 10
    local = pafs.LocalFileSystem()
    for r in random.Random(1).sample(index, 20):
        reader = warc.BundleReader(local.open_input_file(r.bundle))
        head, body = warc.parse_record(reader.frame(r.frame)[r.offset:r.offset + r.length])
        assert head["WARC-Page-ID"] == str(r.page_id) and head["WARC-Date"] and body.decode() == f"page {r.page_id} " * (r.page_id + 1)
