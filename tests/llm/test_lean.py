"""What Python functions on executors hold: one kind of workers, each text once, small batches, no freed memory."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import op3_toxicity, op7_quality
from loomspark.llm.common import SLICE_ROWS, labelled_sample, lean, slices


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def labelled(spark):
    docs = spark.createDataFrame([(i, f"some words of page {i}. More. " * (1 + i % 7), i) for i in range(300)] + [(300, None, 1), (301, "", 1)], "doc_id long, text string, extra int")
    return docs, spark.createDataFrame([(i, int(i % 7 > 2), int(i % 7 > 2)) for i in range(300)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_learning_starts_no_workers_of_a_second_kind(spark, kind):
    docs, labels = (t.withColumn("doc_id", F.col("doc_id").cast(kind)) for t in labelled(spark))
    docs, labels = (spark.createDataFrame(t.toArrow(), t.schema) for t in (docs, labels))
    sample = labelled_sample(docs, labels, "toxic", F.lit(True), 100, 1 << 20)
    assert "LogicalRDD" not in plan(sample) and dict(sample.dtypes)["doc_id"] == docs.dtypes[0][1]
    assert len({r.doc_id for r in sample.collect()}) == sample.count() == 200
    assert labelled_sample(docs, labels.limit(0), "toxic", F.lit(True), 100, 1 << 20).count() == 0


@pytest.mark.parametrize("module, train", [(op3_toxicity, op3_toxicity.train_toxicity), (op7_quality, op7_quality.train_quality)])
def test_a_text_that_is_returned_is_sent_once(spark, module, train):
    docs, labels = labelled(spark)
    model = train(docs, labels)
    whole, alone = module.score(docs, model, docs.columns), module.score(docs, model, ["doc_id"])
    assert "__loom_text" not in plan(whole) and "__loom_text" in plan(alone)
    rows, scores = {r.doc_id: r for r in whole.collect()}, {r.doc_id: r.score for r in alone.collect()}
    assert {i: (r.text, r.extra) for i, r in rows.items()} == {r.doc_id: (r.text, r.extra) for r in docs.collect()}
    assert {i: r.score for i, r in rows.items()} == pytest.approx(scores) and len(scores) == 302
    assert rows[300].text is None and rows[301].text == "" and scores[300] == pytest.approx(scores[301])


def test_slices_are_small_and_whole():
    sizes = [0, 1, SLICE_ROWS, 2 * SLICE_ROWS + 5]
    batches = [pa.record_batch({"a": pa.array(np.arange(n) + 10_000 * k)}) for k, n in enumerate(sizes)]
    found = list(slices(batches))
    assert max(b.num_rows for b in found) == SLICE_ROWS and min(b.num_rows for b in found) > 0
    assert [v for b in found for v in b.column(0).to_pylist()] == [v for b in batches for v in b.column(0).to_pylist()]


def anonymous():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_freed_memory_goes_back():
    kept = []

    def run(batches):
        for _ in batches:
            held = [b"x" * 60_000 for _ in range(4_000)]  # 240 MB, freed but for what stands last
            kept.append(held[-1])
            del held
            yield anonymous()

    before = anonymous()
    (peak,) = lean(run)([None])
    assert anonymous() - before < 60 < peak - before
