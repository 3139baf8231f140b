"""The streaming ingest gives the batch job's result, once."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from fleetbook.operators import loads as L
from fleetbook.plans.params import AS_OF
from fleetbook.sources.fixtures import TestdataTables
from fleetbook.sources.standins import StandinBatches
from fleetbook.streaming import ingest_entry_forms


def test_stream_matches_batch_job(spark):
    t = TestdataTables(spark, SF_SMALL)
    forms = StandinBatches(t).entry_forms
    scratch = tempfile.mkdtemp(prefix="fleetbook-stream-")
    # two files land, one per returned / not returned line
    forms.where(F.col("period_type_text") == "week").write.parquet(f"{scratch}/forms/a")
    forms.where(F.col("period_type_text") != "week").write.parquet(f"{scratch}/forms/b")
    for part in ("a", "b"):
        spark.read.parquet(f"{scratch}/forms/{part}").write.mode("append").parquet(f"{scratch}/landing")

    def run():
        q = ingest_entry_forms(spark, f"{scratch}/landing", forms.schema, t.entries_unique, t.users,
                               t.drivers, t.cars, f"{scratch}/out", f"{scratch}/ckpt", AS_OF)
        q.awaitTermination()

    run()
    got = spark.read.parquet(f"{scratch}/out/entries").drop("ingest_batch")
    rej = spark.read.parquet(f"{scratch}/out/rejects")
    assert got.count() + rej.count() == forms.count()

    v = L.validate_entry_loads(L.clean_entry_forms(forms, t.users, AS_OF), t.drivers, t.cars)
    acc, _ = L.split_loads(v, t.entries_unique)
    want = L.derive_entries(acc)
    cols = sorted(want.columns)
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0

    run()  # nothing new: the checkpoint records the done batches
    assert spark.read.parquet(f"{scratch}/out/entries").count() == got.count()


def test_later_batches_see_earlier_ones(spark):
    t = TestdataTables(spark, SF_SMALL)
    forms = StandinBatches(t).entry_forms
    scratch = tempfile.mkdtemp(prefix="fleetbook-stream2-")
    # the same forms land twice, as two files: the second batch repeats the first
    forms.coalesce(1).write.parquet(f"{scratch}/landing/a")
    forms.withColumn("form_seq", F.col("form_seq") + 10**9).coalesce(1).write.parquet(f"{scratch}/landing/b")
    q = ingest_entry_forms(spark, f"{scratch}/landing/*", forms.schema, t.entries_unique, t.users, t.drivers,
                           t.cars, f"{scratch}/out", f"{scratch}/ckpt", AS_OF, max_files_per_trigger=1)
    q.awaitTermination()
    got = spark.read.parquet(f"{scratch}/out/entries")
    rej = spark.read.parquet(f"{scratch}/out/rejects")
    assert rej.select("ingest_batch").distinct().count() == 2           # two micro-batches ran
    first = got.where(F.col("form_seq") < 10**9).count()
    assert first > 0 and got.where(F.col("form_seq") >= 10**9).count() == 0   # all repeats rejected
    again = rej.where((F.col("form_seq") >= 10**9) & (F.col("reasons") == "duplicate")).count()
    before = rej.where((F.col("form_seq") < 10**9) & (F.col("reasons") == "duplicate")).count()
    assert again == first + before     # what was taken once, by the table or by an earlier form, stays taken
    assert got.count() + rej.count() == 2 * forms.count()
