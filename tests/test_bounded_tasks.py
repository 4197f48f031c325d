"""Tasks whose memory does not grow with the table."""

import pandas as pd
import pyarrow as pa

from echolark.operators import kernels, learning, relational


def test_audio_is_made_a_slice_at_a_time():
    b = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    parts = list(kernels.in_slices(iter([b, b])))
    assert max(p.num_rows for p in parts) <= kernels.SLICE and sum(p.num_rows for p in parts) == 2000
    assert kernels.mfcc_of(b"") == (None, 0) == kernels.mfcc_of(bytes(6400))


def test_cleaning_reports_leave_by_slices(monkeypatch, spark, sf_dir):
    class Rows:
        def select(self, *columns):
            return self

        def mapInPandas(self, f, schema):
            return list(f(iter([pd.DataFrame({"recording_id": range(600), "embedding": [[0.3] * 8] * 600})])))

    monkeypatch.setattr(learning, "read_table", lambda *a: Rows())
    found = learning.cleaning_report(spark, sf_dir)
    assert [len(f) for f in found] == [256, 256, 88] and all("pcm" not in f for f in found)
    assert pd.concat(found).recording_id.tolist() == list(range(600))


def test_more_lines_make_more_tasks(monkeypatch, spark, sf_dir):
    want = sorted(map(tuple, relational.repetition_reviews(spark, sf_dir).collect()))
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(relational, "TASK_ROWS", n // 40)
    found = relational.repetition_reviews(spark, sf_dir)
    assert found.rdd.getNumPartitions() >= 40
    assert sorted(map(tuple, found.collect())) == want
