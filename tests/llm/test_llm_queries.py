"""The registered queries: SQL parity, columns, and the pipeline stage by stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from conftest import SF_CHECK, SF_SMALL
from fleetbook.llm.queries import oracle_sql, queries
from oracle_harness import compare


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_oracle(spark, duck_check, name):
    problems, _, _, _ = compare(spark, duck_check, name, queries()[name], oracle_sql()[name], SF_CHECK)
    assert not problems, problems


@pytest.mark.parametrize("name", ["op5_mixing", "op11_kd_shards", "op13_merkle"])
def test_native_operators_run_no_python(spark, name):
    plan = queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def near_groups(rows):
    """Smallest id of each row's component of 5-word shingle Jaccard >= 0.8."""
    sets, inverse = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for s in sets[i]:
            inverse.setdefault(s, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in sets.items():
        for j in {j for s in own for j in inverse[s] if j > i}:
            if 100 * len(own & sets[j]) >= 80 * len(own | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_pipeline_stages(spark):
    """Each stage against a plain computation on its own input."""
    from fleetbook.llm.common import staged

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [r.doc_id for r in docs.select("doc_id").collect()]
        docs = staged(stage(spark, docs, SF_SMALL), "stage")
        rows = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == columns
            assert all(r.text == texts[r.doc_id] for r in rows)
        after = [r.doc_id for r in rows]
        if name == "language ID":
            assert set(i for i in before if any(c.isalpha() for c in texts[i] or "")) - set(after) == set()
        elif name == "exact dedup":
            norm = {i: "".join((texts[i] or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None}) for i in before}
            best = {}
            for i in before:
                best[norm[i]] = min(best.get(norm[i], i), i, key=lambda k: (-len(texts[k] or ""), k))
            assert sorted(after) == sorted(best.values())
        elif name == "n-gram Jaccard join":
            group = near_groups([(i, texts[i]) for i in before])
            assert sorted(after) == sorted(set(group.values()))
        elif name == "mixing":
            assert set(after) <= set(before) and max(after.count(i) for i in set(after)) <= 3
        else:
            assert sorted(after) == sorted(before)
            for b in {r.bin_id for r in rows if r.bin_id}:
                own = [r for r in rows if r.bin_id == b]
                assert sum(r.tail for r in own) <= 2048 and len({r.doc_id for r in own}) == len(own)


def test_pipeline_runs_whole(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert rows and corpus_pipeline.ORACLE_SQL is None


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_keeps_rows_with_clashing_ids_and_nulls(spark, tmp_path):
    """Clashing and missing ids, nulls in every column, empty texts and columns with the stages' own names."""
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(120).collect()]
    first = base[0][1]
    odd = [(base[0][0], "Another text that shares an id with the first one, in plain English words", "en", "src0", 5), (None, first + " and more of it here", "en", None, None),
           (None, None, None, None, None), (7_000_001, "", "en", "src1", 0), (7_000_002, None, None, "src1", 0)]
    docs = spark.createDataFrame(base + odd, DOCS)
    for c in ("size", "root", "cluster", "row_id", "mix_row", "lang_pred"):
        docs = docs.selectExpr("*", f"'x' as `{c}`")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert stages["n-gram Jaccard join"](spark, rows, "").where(f"doc_id = {base[0][0]} and text like 'Another%'").count() == 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.size for r in got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
