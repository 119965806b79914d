import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import clustering, corpus, quantiles, sequence
from loomspark.operators.quantiles import grouped_quantiles


@pytest.mark.parametrize("shape", ["spread", "ties", "few"])
def test_exact_quantiles(spark, monkeypatch, shape):
    monkeypatch.setattr(quantiles, "SETTLED", 200)
    rng = np.random.default_rng(0)
    x = {"spread": rng.lognormal(size=20_000), "ties": np.repeat([1.0, 2.0, 3.5], [9000, 9000, 2000]), "few": np.array([3.0, 1.0, 2.0])}[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    qs = [0.0, 0.02, 0.25, 0.5, 0.9, 0.98, 1.0]
    assert np.allclose(quantiles.exact_quantiles(df, "x", qs), np.quantile(x, qs), rtol=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), "x", qs) is None


def brute_linkage(x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min((np.mean([1 - x[i] @ x[j] for i in a for j in b]), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q)
        if best[0] >= threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_average_linkage():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1, 6)) + 0.3 * rng.normal(size=(9, 6)) for _ in range(4)])
    for threshold in (0.05, 0.2, 0.5, 1.0):
        labels = clustering.average_linkage(x, threshold)
        assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)} == brute_linkage(x, threshold)
    assert clustering.average_linkage(x[:1], 0.5).tolist() == [0]


def test_assign_and_dimensions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) * [9, 5, 0.1, 0.1, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in clustering.assign(df, x[:3]).collect()}
    assert got == dict(enumerate((x @ x[:3].T).argmax(axis=1).tolist()))
    share = np.cumsum(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    assert clustering.effective_dimensions(df) == int(np.searchsorted(share / share[-1], 0.9) + 1)


def test_monotonic_path_is_best():
    rng = np.random.default_rng(3)
    value = rng.normal(size=(3, 7))
    best = max(sum(value[(t >= a) + (t >= b), t] for t in range(7)) for a in range(1, 7) for b in range(a + 1, 7))
    path = sequence.monotonic_path(value)
    assert np.isclose(sum(value[r, t] for t, r in enumerate(path)), best) and path[0] == 0 and path[-1] == 2 and set(np.diff(path)) <= {0, 1}


def test_chunks():
    text = "یک جمله. " + "، ".join(["بخش"] * 100) + "؟ پایان!"
    parts = sequence.chunks(text)
    assert parts[0] == "یک جمله." and parts[-1] == "پایان!" and max(map(len, parts)) <= 220 and "".join(parts).replace(" ", "") == text.replace(" ", "")
    assert sequence.chunks("  ") == []


def test_split_and_leak(spark):
    clusters = spark.createDataFrame([(i, 50 + i) for i in range(40)], "cluster long, n long")
    held = corpus.hold_out(clusters, 400, 5)
    assert 0 < held.count() <= 5 and held.columns == ["cluster", "n"]
    corpus.check_leak(clusters.join(held, "cluster", "left_anti"), held)
    with pytest.raises(corpus.LeakError):
        corpus.check_leak(clusters, held)
    with pytest.raises(ValueError):
        corpus.align(clusters.withColumnRenamed("cluster", "idx"), clusters.limit(3).withColumnRenamed("cluster", "idx"))


def test_window_and_tier(spark):
    rows = [(i, float(i % 100), None if i % 7 == 0 else float("nan") if i % 7 == 1 else 3.0, 5.0) for i in range(1000)] + [(1000, float("nan"), 3.0, 5.0), (1001, float("inf"), 3.0, 5.0)]
    df = spark.createDataFrame(rows, "idx long, rate double, mos_ovr double, duration double")
    low, high = corpus.fit_window(df)
    positive = [r[1] for r in rows[:1000] if r[1] > 0]
    assert np.allclose([low, high], np.quantile(positive, [0.02, 0.98]))
    kept = df.filter(corpus.tier("mos_ovr", 3.0, "duration", 5.0, 5.0, "rate", (low, high)))
    assert kept.count() == sum(r[2] == 3.0 and low <= r[1] <= high for r in rows) and corpus.mos_columns(df) == ["mos_ovr"]
    assert df.filter(F.col("idx") < 0).select("rate").count() == 0 and corpus.fit_window(df.limit(0)) is None


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=30_000), "b": np.round(rng.exponential(size=5_000)), "c": np.array([4.0]), "d": np.arange(10.0), "e": np.full(900, 2.0), None: rng.normal(size=17), "f": np.append(np.full(2_000, 1.0), np.arange(2.0, 900.0))}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("g", None)]
    wanted = [0.0, 0.02, 0.25, 0.5, 0.9, 0.98, 1.0]
    got = {r.g: r.ps for r in grouped_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", wanted).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert np.allclose(got[g], np.quantile(xs, wanted), rtol=0, atol=1e-12), g


def test_align_groups_of_all_shapes(spark, monkeypatch):
    monkeypatch.setattr(sequence, "MATRIX_CELLS", 100)
    rng = np.random.default_rng(5)
    grids = {k: np.round(rng.normal(size=(int(rng.integers(1, 9)), int(rng.integers(1, 12)))), 1) for k in [*range(60), None]}
    cells = [(k, 10 * r, -t, float(x)) for k, g in grids.items() for r, line in enumerate(g) for t, x in enumerate(line[::-1])]
    # Lesser doubles, cells that are missing, cells without a value, and a group that has none.
    cells += [(k, r, t, x - 1) for k, r, t, x in cells[::7]] + [(0, 5, 5, float("nan")), (1, None, 0, 9.0), (2, 0, None, 9.0), (99, 0, 0, None), (99, 1, 1, float("nan"))]
    cells += [(200, 0, 0, 1.0), (200, 0, 1, float("-inf")), (200, 1, 1, 1.0), (200, 1, 2, float("inf"))]
    grids[200] = np.array([[1.0, np.nan_to_num(-np.inf), -1e9], [-1e9, 1.0, np.nan_to_num(np.inf)]])
    df = spark.createDataFrame(cells, "k long, r int, t int, x double").repartition(5)
    out = sequence.align_groups(df, "k", "r", "t", "x")
    got = {}
    for row in out.orderBy("k", "frame").collect():
        got.setdefault(row.k, []).append(row.row)
    assert got == {k: sequence.monotonic_path(g).tolist() for k, g in grids.items()}
    # No call of Python for each group.
    assert "InPandas" not in out._jdf.queryExecution().toString()


def test_shard_of_a_table_in_parts(spark, tmp_path):
    from loomspark.plans import frontend
    from loomspark.sources import files

    folder = tmp_path / "a b+c%20.parquet"
    spark.range(60).withColumnRenamed("id", "doc_id").repartition(3).write.parquet(str(folder / "documents.parquet"))
    for place in (f"{folder}", f"file:{folder}/", f"file://{folder}/../{folder.name}"):
        assert {(r.shard, r["count"]) for r in frontend.source_file(spark, place).groupBy("shard").count().collect()} == {("documents.parquet", 60)}
    # Files of a folder are shards of their own, whatever stands in their names.
    parts = sorted((folder / "documents.parquet").glob("*.parquet"))
    names = ["x y+z.parquet", "p%20q.parquet", "ü.parquet"]
    for part, name in zip(parts, names):
        part.rename(folder / name)
    assert {r.shard for r in files.with_shard(files.parquet_folder(spark, str(folder)), str(folder)).select("shard").distinct().collect()} == set(names)


def test_edit_distance(spark):
    import random

    from loomspark.plans import scoring

    def plain(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
            line = new
        return line[-1]

    draw = random.Random(1)
    for k in range(3000):
        a, b = ("".join(draw.choices(("ab", "abcde é")[k % 2], k=draw.randint(0, 70 if k % 50 == 0 else 9))) for _ in "ab")
        assert sequence.edit_distance(a, b) == plain(a, b), (a, b)
    # The score of a pair is not made again for every threshold.
    assert "levenshtein" not in scoring.QUERIES["keep_rate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_text_counts(spark, monkeypatch):
    import random
    import re

    import pyarrow as pa

    from loomspark.plans import audit

    monkeypatch.setattr(corpus, "COUNT_BYTES", 50)
    draw = random.Random(2)
    texts = ["".join(draw.choices("aZ09 \t\n\r ÀÖ×Øö÷øÿßÃ·—ا‌😀@[`{", k=draw.randint(0, 40))) for _ in range(400)] + ["", "", " ", "a", "é", "×", "x" * 300, " a", "b"]
    letters, words = corpus.count_text(pa.array(["cut off", *texts], pa.string()).slice(1))
    assert letters.tolist() == [len(re.sub(audit.LETTERS, "", t)) for t in texts]
    assert words.tolist() == [len(re.findall("[^ \t\n]+", t)) for t in texts]
    assert [len(x) for x in corpus.count_text(pa.array([], pa.string()))] == [0, 0]
    for name in ("text_profile", "text_percentiles", "loader_filters"):
        assert "regexp_" not in audit.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_audit_of_shards_reads_texts_once(spark):
    from loomspark.plans import audit

    plan = audit.audit_shards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and "manifest-" in plan


def test_assignment_is_bounded_in_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    x, centroids = rng.integers(-3, 4, size=(4096, 8)).astype(float), rng.integers(-3, 4, size=(6000, 8)).astype(float)
    tracemalloc.start()
    cluster, confidence = clustering.nearest_centroids(x, centroids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All products together are 197 MB.
    assert peak < 3 * 8 * clustering.ASSIGN_PRODUCTS
    near = x @ centroids.T
    assert (cluster == near.argmax(axis=1)).all() and (confidence == near.max(axis=1)).all()
