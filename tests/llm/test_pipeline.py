"""The pipeline's stages against brute force, and the guard that lets the rest live without it."""

import subprocess
import sys
from collections import Counter

import corpus_pipeline
from loomspark.llm import op3_toxicity, op5_line_dedup, op7_quality
from loomspark.llm.common import durable
from test_near_copies import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, "", "en", None, 0), (10**6 + 2, "a b c", None, "src1", 5), (10**6 + 2, "a b c", None, "src1", 5)], base.schema)
    docs = durable(base.unionByName(extra), "t")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, durable(stage(spark, docs, SF), "t")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    a, b = seen["toxicity"]
    scores = op3_toxicity.score(a, op3_toxicity.train_toxicity(a, labels), a.columns)
    assert Counter(map(tuple, b.collect())) == Counter(tuple(r)[:-1] for r in scores.collect() if r.score < 0.3)
    a, b = seen["quality"]
    scores = op7_quality.score(a, op7_quality.train_quality(a, labels), a.columns)
    assert Counter(map(tuple, b.collect())) == Counter(tuple(r)[:-1] for r in scores.collect() if r.score >= 0.3)
    a, b = seen["line_dedup"]
    assert Counter((r.doc_id, r.text) for r in b.collect()) == Counter((r.doc_id, r.text) for r in op5_line_dedup.drop_boilerplate(a).collect())
    assert all(r.n_chars == len(r.text) for r in b.collect() if r.text and r.doc_id < 10**6)
    a, b = seen["near_dedup"]
    want, links = brute(sorted({(r.doc_id, r.text or "") for r in a.collect()}))
    assert sorted(r.doc_id for r in b.collect()) == sorted(set(want.values())) and links
    a, b = seen["packing"]
    assert {r.doc_id for r in b.select("doc_id").collect()} == {r.doc_id for r in a.select("doc_id").collect()}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, SF), "t")
    assert docs.count() == 0


def test_rest_stands_without_the_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('loomspark.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
