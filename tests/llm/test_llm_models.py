"""Language ID and LM scoring."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from fleetbook.llm import langid, lm_score
from fleetbook.llm.common import id_crc
from fleetbook.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- language ID ---------------------------------------------------------------------------

def test_char_model_is_a_distribution():
    letters = langid.letter_table()
    key, _, _ = langid.symbols(["the cat sat on the mat and the rat ran to the man"] * 3 + ["that hat"], letters)
    grams, n = np.unique(key, return_counts=True)
    alphabet = np.unique(key & np.uint64(0xFFFF))
    model = langid.CharModel(grams, n, 1.0 / (len(alphabet) + 1))
    for context in np.unique(key >> np.uint64(16)):
        p = np.exp2(model.log2((context << np.uint64(16)) | alphabet))
        rest = np.exp2(model.log2(np.array([(context << np.uint64(16)) | np.uint64(0x4E00)])))
        assert math.isclose(p.sum() + rest[0], 1.0, rel_tol=1e-9)


def brute_keys(text):
    out, prev = [], True
    for c in text.lower():
        if c.isalpha():
            out.append(ord(c))
            prev = True
        elif prev:
            out.append(32)
            prev = False
    return [sum((out[i - b] if i >= b else 32) << (16 * b) for b in range(4)) for i in range(len(out))]


def test_symbols_match_brute_force():
    texts = ["Hello,  World 42!", "", None, "...", "ÄÖ ü", "a", "x" * 3000 + " 1 " + "y"]
    key, starts, has = langid.symbols(texts, langid.letter_table())
    for k, t in enumerate(texts):
        assert key[starts[k]:starts[k + 1]].tolist() == brute_keys(t or "")
        assert has[k] == any(c.isalpha() for c in t or "")


def test_score_table_changes_nothing():
    letters = langid.letter_table()
    key, _, _ = langid.symbols(["some words that we count", "and others here"], letters)
    grams, n = np.unique(key, return_counts=True)
    models = langid.Models(["a"], [langid.CharModel(grams, n, 0.01)])
    texts = [f"word{k} other text {chr(97 + k % 26) * 5}" for k in range(200)]
    small, large = models.scorer(slots=16), models.scorer()
    for _ in range(2):
        assert np.allclose(small(texts)[0], large(texts)[0])


def test_held_out_accuracy(spark):
    got = queries()["op2_language_id"](spark, SF_CHECK)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang").collect()}
    rows = got.collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 2


def test_language_id_edge_cases(spark):
    train = [(k, "the quick brown fox and the lazy dog " * 3, "en", "s", 0) for k in range(20)]
    train += [(100 + k, "der schnelle braune fuchs und der faule hund " * 3, "de", "s", 0) for k in range(20)]
    odd = [(None, "the dog", None, None, None), (200, None, "en", "s", 0), (201, "", "en", "s", 0), (202, "123 !!", "de", "s", 0),
           (203, "und der hund", None, "s", 0), (203, "und der hund", None, "s", 0), (204, "the fox " * 20_000, None, "s", 0), (205, "\U00010400", "en", "s", 0)]
    df = spark.createDataFrame(train + odd, DOCS).withColumn("part", F.lit(1)).withColumn("rejected", F.lit(2))
    models = langid.train(df, id_crc("doc_id") % 4 != 2)
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in langid.predict(df, models).collect()}
    assert {(None, "en", True), (200, "und", False), (201, "und", False), (202, "und", False), (203, "de", True), (204, "en", True)} <= got
    kept = langid.accepted_rows(df, models)
    assert kept.columns == df.columns and not {200, 201, 202} & {r.doc_id for r in kept.collect()}
    assert kept.count() == df.count() - langid.predict(df, models).filter("rejected").count()
    none = langid.train(df.filter("lang = 'xx'"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), models).count() == 0


def test_rejection_on_both_sides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    learn = id_crc("doc_id") % 4 != 2
    for left_out in ("en", "es"):
        models = langid.train(docs.filter(F.col("lang") != left_out), learn)
        rows = docs.filter(~learn & (F.length("text") >= 100))
        n = {(r.out, r.rejected): r["count"] for r in langid.predict(rows, models).join(rows.select("doc_id", (F.col("lang") == left_out).alias("out")), "doc_id")
             .groupBy("out", "rejected").count().collect()}
        assert n.get((True, False), 0) <= 0.03 * n[True, True]  # of the language that was not learned
        assert n.get((False, True), 0) <= 0.003 * n[False, False]  # clean texts lost


def test_limits_with_few_texts():
    rnd = np.random.default_rng(3)
    nearest = np.array([0] * 200 + [1] * 100 + [2] * 2)
    size = np.full(len(nearest), 900)
    entropy = np.where(nearest == 1, 3.0, 2.0) + rnd.normal(0, 0.05, len(nearest))
    entropy[0] = 9.0  # one odd text does not set the limit
    limits = langid.limits_of(["a", "b", "c", "d"], nearest, entropy, size)
    at = {x: level + spread / 30 for x, (level, spread) in limits.items()}
    assert 2.4 < at["a"] < 3.2 and 3.6 < at["b"] < 4.8
    assert at["c"] == at["d"] == at["b"]  # too few texts, or none: bounded all the same
    level, spread = limits["a"]
    assert spread > 0 and langid.limits_of(["a"], nearest[:0], entropy[:0], size[:0]) == {}


# --- LM scoring ----------------------------------------------------------------------------

def brute_lm(rows):
    toks = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    uni, bi = Counter(), Counter()
    for i, w in toks:
        if crc(i) != 2:
            uni.update(w)
            bi.update(zip([None] + w[:-1], w))
    follow = Counter(h for h, _ in bi)
    n, v, out = sum(uni.values()), len(uni), []
    for i, w in toks:
        base = score = 0.0
        for h, x in zip([None] + w[:-1], w):
            p = (uni[x] + 1) / (n + v + 1)
            left = lm_score.DISCOUNT * follow[h] / uni[h] if uni[h] else 1.0
            c = bi[h, x]
            base += math.log10(p)
            score += math.log10((max(c - lm_score.DISCOUNT, 0) / uni[h] if uni[h] else 0) + left * p)
        out.append((i, crc(i) == 2, len(w), sum(uni[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def scored(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                   for r in lm_score.score(df, id_crc("doc_id") % 7 != 2).collect()), key=repr)


def test_lm_scores_match_brute_force(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").limit(250).collect()]
    rows += [(None, "the the"), (10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "a " * 30_000), (10_005, "x y z"), (10_005, "x y z")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).selectExpr("*", "1 as block", "2 as flag").repartition(4)
    assert scored(df) == brute_lm(rows)


def test_lm_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm_score.score(df, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0.0)
    assert lm_score.score(df.limit(0), F.lit(True)).count() == 0


def test_automaton_states_are_distributions():
    # words 0..2; arcs 0->1 (2 of 4), 0->2 (1 of 4), training counts 4, 2, 1 of 7 tokens and 3 types
    words, followers = np.array([4, 2, 1]), np.array([2, 0, 0])
    first, second = np.array([0, 0, 0]), np.array([0, 1, 2])
    a = lm_score.BackoffAutomaton(words, followers, np.array([0, 3, 1]), first, second, 7, 3)
    p = 10 ** a.traverse(first, second, np.arange(3))
    unseen = 10 ** (a.failure[0] + math.log10(1 / 11))
    assert math.isclose(p.sum() + unseen, 1.0, rel_tol=1e-9)
