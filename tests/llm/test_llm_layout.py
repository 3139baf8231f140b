"""Sharding, whitening and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from fleetbook.llm import kd_shards, merkle, whitening
from fleetbook.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- Merkle manifest --------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(i, text, lang, source, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree_of(nodes, fanout=16):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    return levels


def path_of(levels, i, fanout=16):
    out = []
    for x in levels[:-1]:
        run = x[i // fanout * fanout : (i // fanout + 1) * fanout]
        out.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        i //= fanout
    return out


def brute_manifest(rows, fanout=16):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = leaf_of(i, text, lang, source, n)
        touched = i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None
        by[source].append((i is not None, i, leaf, leaf_of(i, text.translate(lower), lang, source, n) if touched else leaf))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([x[2] for x in sorted(by[g], key=lambda x: (x[0], x[1] or 0, x[2]))], fanout) for g in groups}
    over = tree_of([trees[g][-1][0] for g in groups], fanout) if groups else []
    out = []
    for k, g in enumerate(groups):
        for r, (_, i, leaf, folded) in enumerate(sorted(by[g], key=lambda x: (x[0], x[1] or 0, x[2]))):
            path = path_of(trees[g], r, fanout) + path_of(over, k, fanout)
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((i, leaf, trees[g][-1][0], over[-1][0], sha("".join(a + b for a, b in path)), folded, folded == over[-1][0]))
    return sorted(out, key=repr)


def audited(docs):
    return sorted(map(tuple, merkle.audit(docs).collect()), key=repr)


MERKLE_EDGES = [
    (1, "Abc", "en", "s", 3), (2, None, None, "s", None), (None, "null id", "en", "s", 7), (None, "null id", "en", "s", 7), (3, "", "en", None, 0), (4, "é\U0001f600", "fr", None, 2),
    (5, "Same", "en", "t", 4), (5, "Same", "en", "t", 4), (6, "X" * 200_000, "en", "lone", 200_000), (-7, "neg", "", "", 3), (8, "b", "en", "￿", 1), (9, "c", "en", "\U0001f600", 1),
]


def test_merkle_edge_cases(spark):
    docs = spark.createDataFrame(MERKLE_EDGES, DOCS)
    for c in ("tree", "kids", "hash", "rank", "n", "at", "part", "block", "path", "above", "TEXT_1", "d0"):
        docs = docs.selectExpr("*", f"'x' as `{c}`")
    assert audited(docs) == brute_manifest(MERKLE_EDGES)


def test_merkle_empty_table_and_lone_leaf(spark):
    assert audited(spark.createDataFrame([], DOCS)) == []
    [row] = audited(spark.createDataFrame([(5, "A", "en", "s", 1)], DOCS))
    leaf = leaf_of(5, "A", "en", "s", 1)
    assert row[1:5] == (leaf, leaf, leaf, sha(""))


@pytest.mark.parametrize("digits", [1, 2])
def test_merkle_tiers(spark, monkeypatch, digits):
    """Groups of several blocks, and more groups than a block holds."""
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rng = random.Random(digits)
    rows = [(i, f"Text {i}", "en", "hot" if i % 3 == 0 else f"s{rng.randrange(300 if digits == 1 else 20)}", i) for i in range(900)]
    assert audited(spark.createDataFrame(rows, DOCS).repartition(7)) == brute_manifest(rows)


def test_merkle_whole_query(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries()["op13_merkle"](spark, SF_SMALL).collect()), key=repr) == brute_manifest(rows)


# --- k-d tree shards --------------------------------------------------------------------

def shard_rows(spark, rows, **kw):
    return kd_shards.kd_shards(spark.createDataFrame(rows, DOCS), **kw).collect()


def check_law(rows, got, shards, slack):
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    text = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == text
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for k in range(shards):
        assert abs(sum(r.size for r in by[k]) - total / shards) <= slack * total / shards + largest


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_are_near_equal_with_a_hot_source_and_a_hot_group(spark, shards):
    rng = random.Random(shards)
    rows = [(i, "copy " * 20 if i % 3 == 0 else f"{rng.random()} " * rng.randrange(1, 40), rng.choice("abc"), "hot" if i % 5 else f"s{i % 50}", rng.randrange(5000)) for i in range(3000)]
    check_law(rows, shard_rows(spark, rows, shards=shards), shards, 0.03)


def test_groups_stay_together_where_they_fit(spark):
    rng = random.Random(7)
    rows = [(i, f"group {i % 900} " * (1 + i % 900 % 7), "en", f"s{rng.randrange(9)}", rng.randrange(100)) for i in range(2700)]
    got = shard_rows(spark, rows, shards=2)
    check_law(rows, got, 2, 0.05)
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert len(homes) == 900 and max(map(len, homes.values())) == 1


def test_cuts_are_weighted_medians_of_the_widest_dimension(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), "x" * int(rng.pareto(1.2) * 20 + 1) + str(i), "en", "s", int(rng.integers(1, 10**6))) for i in range(4000)]
    units, total = kd_shards._units(spark.createDataFrame(rows, DOCS), 8)
    tree = kd_shards.kd_tree(units, 8, total / (8 * kd_shards.GRAIN * 8))
    table = units.toPandas()
    extent = {c: np.ptp(table[c]) or 1 for c in kd_shards.DIMS}

    def check(node, part):
        if node.left is None:
            return
        widths = {c: np.ptp(part[c]) / extent[c] for c in kd_shards.DIMS}
        assert widths[node.dim] == max(widths.values())
        order = part.sort_values([node.dim, "key", "piece"])
        sums, goal = order["size"].cumsum().to_numpy(), part["size"].sum() / 2
        best = np.abs(np.append(0, sums) - goal).min()
        below = np.array([(x, y, z)[: len(node.cut)] < node.cut for x, y, z in zip(part[node.dim], part["key"], part["piece"], strict=True)])
        assert abs(part["size"][below].sum() - goal) <= best + total / (8 * kd_shards.GRAIN * 8)
        check(node.left, part[below])
        check(node.right, part[~below])

    check(tree, table)


def test_shards_edge_cases(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (3, "y" * 100_000, "en", "s", 5), (4, "é", "", "", -3), (5, "same", "a", "b", 1), (5, "same", "a", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("size", "crc", "key", "piece", "tie", "place", "c0", "shard", "rank", "n", "at"):
        docs = docs.selectExpr("*", f"'z' as `{c}`")
    got = kd_shards.kd_shards(docs, shards=4).collect()
    check_law(rows, got, 4, 1.0)
    assert {r.shard for r in got if r.size == 1} and len({r.shard for r in got if r.size == 1}) == 1
    assert kd_shards.kd_shards(docs, target_bytes=10**9).agg({"shard": "max"}).first()[0] == 0
    assert kd_shards.kd_shards(docs.limit(0), shards=4).collect() == []
    with pytest.raises(ValueError):
        kd_shards.kd_shards(docs, target_bytes=1)


def test_same_shards_however_the_rows_lie(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    one = sorted(map(tuple, kd_shards.kd_shards(docs.repartition(3, "n_chars"), shards=16).collect()), key=repr)
    assert one == sorted(map(tuple, queries()["op11_kd_shards"](spark, SF_SMALL).collect()), key=repr)


# --- whitening ---------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.sampled_from(["random", "cluster", "rank one", "identity", "zero", "graded"]), st.integers(0, 2**32 - 1))
def test_spectrum_by_divide_and_conquer(n, kind, seed):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {
        "random": rng.standard_normal(n) * 100, "cluster": np.repeat([5.0, 1.0], [n // 2, n - n // 2]) + 1e-9 * rng.random(n), "rank one": np.append(7.0, np.zeros(n - 1)),
        "identity": np.ones(n), "zero": np.zeros(n), "graded": 10.0 ** -np.linspace(0, 14, n),
    }[kind]
    a = q * values @ q.T
    a = (a + a.T) / 2
    e, v = whitening.spectrum(a)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-12 * scale
    assert np.abs(v.T @ v - np.eye(n)).max() <= 1e-12 and np.abs(a @ v - v * e).max() <= 1e-12 * scale


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(0, 2**32 - 1))
def test_polar_factor(n, seed):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    e = rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-8, 3, n)
    u = whitening.polar((q * e @ q.T + (q * e @ q.T).T) / 2)
    assert np.abs(u @ u - np.eye(n)).max() <= 1e-12 and round(np.trace(u)) == np.sign(e).sum()


def brute_whitening(vectors):
    """x, n, S, and the whitened values of usable vectors up to the components' signs."""
    ok = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    ids, x = [i for i, _ in ok], np.floor(256 * np.array([v for _, v in ok], dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, b = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    e, b = e[::-1][:4], b[:, ::-1][:, :4]
    return ids, n, ((n * x - s) ** 2).sum(1), (x - s / n) @ b / np.sqrt(e), e / np.trace(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))


def check_whitening(vectors, rows):
    ids, n, deviation, white, explained = brute_whitening(vectors)
    k = white.shape[1]
    assert Counter((r.vec_id, r.component) for r in rows) == Counter((i, c) for i in ids for c in range(1, k + 1))
    want = {}
    for i, d, w in zip(ids, deviation, white, strict=True):
        want[i] = (int(d), w)
    signs = np.ones(k)
    for c in range(k):
        both = [(r.whitened, want[r.vec_id][1][c]) for r in rows if r.component == c + 1]
        signs[c] = np.sign(sum(a * b for a, b in both))
    for r in rows:
        d, w = want[r.vec_id]
        assert r.n == n and r.deviation == d
        assert abs(r.whitened - signs[r.component - 1] * w[r.component - 1]) < 1e-8
        assert abs(r.explained - explained[r.component - 1]) <= 1e-10 and r.identity_error <= 1e-9


def test_whitening_whole_query(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check_whitening(vectors, queries()["op12_whitening"](spark, SF_SMALL).collect())


def test_whitening_copies_weigh_nothing_and_bad_vectors_go(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.standard_normal(6) * [5, 4, 3, 2, 1, 0.5]]) for i in range(80)]
    rows = good + [(1000 + i, good[0][1]) for i in range(200)] + [(None, good[1][1])]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5), (2005, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "vec_id long, embedding array<double>, dim int, x int").repartition(5)
    got = whitening.whiten(table).collect()
    check_whitening(rows, got)


def test_whitening_degenerate_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])], kind)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.component) for r in rows] == [(1, 1), (2, 1), (3, 1)]
    assert abs(abs(rows[0].whitened) - 1.5**0.5) < 1e-12 and rows[0].explained == pytest.approx(1)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [-1e30, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None} and len(huge) == 6
