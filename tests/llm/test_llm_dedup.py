"""Exact dedup, n-gram join, components and embedding near-dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from fleetbook.llm import exact_dedup, hnsw, ngram_join
from fleetbook.llm.common import SPACES
from fleetbook.llm.components import components, forest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


EDGES = [(5, "a b c"), (3, "abc"), (4, "a  b c"), (9, None), (8, ""), (7, " \t\n"), (1, "x" * 50_000), (2, "x" * 50_000),
         (None, "abc"), (None, "alone"), (6, "a\x0bb\x0cc"), (10, "Abc"), (11, "a bc"), (12, "é"), (12, "é")]


# --- exact dedup ------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**20 - 1), max_size=40), min_size=1, max_size=4))
def test_counting_quotient_filters_are_lossless(parts):
    filters, want = [], {}
    for part in parts:
        values, counts = np.unique(np.array(part, dtype=np.uint64), return_counts=True)
        f = exact_dedup.CountingQuotientFilter.of(values, counts, 20)
        f = exact_dedup.CountingQuotientFilter.from_row(f.to_row())
        got, n = f.entries()
        assert got.tolist() == values.tolist() and n.tolist() == counts.tolist()
        filters.append(f)
        for v in part:
            want[v] = want.get(v, 0) + 1
    values, counts = exact_dedup.merge(filters)
    assert dict(zip(values.tolist(), counts.tolist())) == want


def brute_exact(rows):
    norm = [(i, t or "", "".join(c for c in t or "" if c not in SPACES)) for i, t in rows]
    out = []
    for i, _, n in norm:
        same = [x for x in norm if x[2] == n]
        keep = min(same, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        out.append((i, keep, len(same), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups_edge_cases(spark):
    got = exact_dedup.exact_groups(docs_of(spark, EDGES))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact(EDGES)
    assert exact_dedup.exact_groups(docs_of(spark, [])).count() == 0


def test_exact_kept_rows(spark):
    df = docs_of(spark, EDGES).selectExpr("*", "doc_id as fp", "text as row", "1 as again", "'c' as norm")  # clashing names
    kept = exact_dedup.kept_rows(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == len({r[4] for r in brute_exact(EDGES)})
    want = {r[4]: r[1] for r in brute_exact(EDGES)}
    for r in rows:
        assert want[hashlib.sha256("".join(c for c in r.text or "" if c not in SPACES).encode()).hexdigest()] == r.doc_id


# --- components -------------------------------------------------------------------------

def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    nodes = [rnd.randint(-10**12, 10**12) for _ in range(120)]
    edges = [tuple(rnd.sample(nodes, 2)) for _ in range(90)] + [(nodes[0], nodes[0])]
    chain = list(range(40))
    edges += list(zip(chain, chain[1:])) + [(7, k) for k in range(100, 160)]
    want = union_find(set(nodes) | set(chain) | set(range(100, 160)), edges)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {n: want[n] for n in touched}
    u, v = forest(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert {x: y for x, y in zip(u.tolist(), v.tolist())} == {n: r for n, r in want.items() if n in touched and r != n}


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram Jaccard join -----------------------------------------------------------------

def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union_find(range(len(rows)), edges)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[k] and rows[m][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else i))
    return sorted(out, key=repr)


def near_copies(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(500)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_join_components(spark, seed):
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randrange(3000)}"
    texts = []
    for size, n, edits in ((60, 40, 4), (150, 25, 8), (6, 10, 1), (30, 10, 1)):
        texts += near_copies(rnd, [word() for _ in range(size)], n, edits)
    shared = " ".join(word() for _ in range(40))  # a passage that many documents share
    texts += [" ".join(word() for _ in range(60)) + " " + shared for _ in range(30)]
    rows = [(100 + k, t) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One TWO"), (5, "one two"), (6, "two one"), (None, texts[0]), (7, texts[1]), (7, texts[1])]
    got = ngram_join.join_components(docs_of(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_join(rows)


def test_join_sub_blocks_agree(spark, monkeypatch):
    rnd = random.Random(9)
    rows = list(enumerate(near_copies(rnd, [f"v{k}" for k in range(80)], 60, 6)))
    monkeypatch.setattr(ngram_join, "SUB_MEMBERS", 7)  # many pairs of sub-blocks
    assert sorted(map(tuple, ngram_join.join_components(docs_of(spark, rows)).collect()), key=repr) == brute_join(rows)


def test_join_of_nothing_and_kept_rows(spark):
    assert ngram_join.join_components(docs_of(spark, [])).count() == 0
    text = " ".join(f"a{k}" for k in range(100))
    df = docs_of(spark, [(1, text), (2, text + " b"), (3, "other words here"), (4, None)]).selectExpr("*", "1 as sig", "2 as component_id")
    kept = ngram_join.kept_rows(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_prefix_length_keeps_every_partner():
    for n in range(1, 200):
        need = -(-80 * n // 100)  # least intersection with any partner
        assert ngram_join.prefix_length(n, 80) == n - need + 1


# --- embedding near-dedup ----------------------------------------------------------------

def brute_vectors(rows, cosine=0.9):
    unit = {}
    for k, (_, v) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in v or []], dtype=float)
        if len(x) and np.isfinite(x).all() and x.any():
            unit[k] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if b < a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    root = union_find(range(len(rows)), links)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[k] and rows[m][0] is not None]
        comp = min(ids) if ids else i
        out.append((i, sum(k in e for e in links), comp, i == comp))
    return sorted(out, key=repr)


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(300)]
    for c in range(6):
        base = rng.normal(size=16)
        rows += [(1000 + 100 * c + k, (base + rng.normal(size=16) * 0.1).tolist()) for k in range(40)]
    rows += [(5000 + k, rows[0][1]) for k in range(5)] + [(None, rows[1][1])]
    rows += [(6000, None), (6001, []), (6002, [0.0] * 16), (6003, [float("nan")] * 16), (6004, [float("inf")] + [0.0] * 15),
             (6005, [1.0, 2.0]), (6006, [2.0, 4.0]), (6007, [None] + [1.0] * 15)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, key int, unit int")
    got = sorted(map(tuple, hnsw.near_duplicates(df).collect()), key=repr)
    want = brute_vectors([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows])
    assert [g[:1] + g[2:] for g in got] == [w[:1] + w[2:] for w in want]
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.near_duplicates(empty).count() == 0


def test_graph_finds_whole_dense_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(800, 32)), rng.normal(size=32) + 0.1 * rng.normal(size=(500, 32))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    level = hnsw.levels_of(np.arange(len(x), dtype=np.int64) * 7919)
    order = np.argsort(-level, kind="stable")
    x = x[order]
    graph = hnsw.Graph.build(x, level[order])
    true = x @ x.T >= 0.9
    found = graph.search(x, 24, 0.9)
    assert all(true[i][h].all() for i, h in enumerate(found))
    assert sum(len(h) for h in found) >= 0.99 * true.sum()


# --- rows that stay ---------------------------------------------------------------------

SENTENCE = " ".join(f"word{i}" for i in range(60))


def test_kept_rows_go_by_row(spark):
    """Of rows with one id only those go whose own text has a partner that stays."""
    near = SENTENCE.replace("word59", "changed")
    rows = [(1, SENTENCE), (2, SENTENCE), (2, "a quite different text of its own"), (3, near), (None, near + " more"), (None, "no id, no partner at all"),
            (4, None), (4, ""), (5, "short"), (5, "short"), (6, "short"), (7, "x " * 40_000 + "end"), (8, "x " * 40_000 + "end")]
    docs = docs_of(spark, rows)
    for c in ("row_id", "gone_id", "kept_row", "carried", "root"):
        docs = docs.selectExpr("*", f"1 as `{c}`")
    got = ngram_join.kept_rows(docs)
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    want = [(1, SENTENCE), (2, "a quite different text of its own"), (None, "no id, no partner at all"), (4, None), (4, ""), (5, "short"), (5, "short"), (7, "x " * 40_000 + "end")]
    assert left == sorted(want, key=repr)
    nulls = docs_of(spark, [(None, SENTENCE), (None, near)])
    assert ngram_join.kept_rows(nulls).count() == 1
    assert ngram_join.kept_rows(docs_of(spark, [])).collect() == []


def test_clusters_handed_over_by_the_join(spark):
    near = SENTENCE.replace("word59", "changed")
    rows = [(1, SENTENCE), (1, near), (None, SENTENCE), (2, "alone with a few words"), (3, None), (4, " ")]
    got = ngram_join.clustered(docs_of(spark, rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id"))), F.col("source")).collect()
    assert sorted(r.words for r in got) == [0, 0, 5, 60, 60, 60]
    assert len({r.cluster for r in got if r.words == 60}) == 1 and {r.cluster for r in got if r.words == 0} == {None}
    assert {(r.doc_id, r.carried) for r in got} == {(1, "s1"), (None, None), (2, "s2"), (3, "s3"), (4, "s4")}


def test_every_member_of_a_component_has_links(spark):
    """n_links counts links found from either end, exactly, also beside a dense group."""
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(16)
    rows = [centre + 0.05 * rng.standard_normal(16) for _ in range(400)]
    for _ in range(150):
        x = rng.standard_normal(16)
        rows += [x, x + 0.08 * rng.standard_normal(16), x + 0.11 * rng.standard_normal(16)]
    rows += [rng.standard_normal(16) for _ in range(200)]
    vectors = np.array(rows)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in hnsw.near_duplicates(df).collect()}
    size = {}
    for r in got.values():
        size[r.component_id] = size.get(r.component_id, 0) + 1
    assert all((r.n_links > 0) == (size[r.component_id] > 1) for r in got.values())
    assert np.mean([got[i].n_links == near[i].sum() for i in got]) >= 0.99


def test_exact_groups_of_an_empty_table(spark):
    assert exact_dedup.exact_groups(docs_of(spark, [])).collect() == [] and exact_dedup.kept_rows(docs_of(spark, [])).collect() == []
