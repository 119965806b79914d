import math

from pyspark.sql import functions as F

from loomspark.streaming.guard import GuardState, Rules, guard_stream, windowed_means

RULES = Rules(warm_up=2, patience=2, targets={"snr": (5, 20.0)}, floors={"disc": 0.01}, ceilings={"loss": 100.0}, usd_per_hour=2.0, budget=10.0)


def run(records, rules=RULES):
    state = GuardState()
    return [(s, r) for s, m, h in records if (r := state.apply(rules, s, m, h))]


def test_bounds():
    assert run([(1, {"loss": 999.0}, 0), (2, {"loss": 999.0}, 0), (3, {"loss": 999.0}, 0)]) == [(2, "loss above 100.0")]  # warm-up, then once
    assert run([(4, {"snr": 25.0}, 0), (5, {"snr": 25.0}, 0)]) == [(5, "snr above 20.0")]  # from its step on
    assert run([(2, {"disc": 0.001}, 0)]) == [(2, "disc below 0.01")]
    assert run([(9, {"loss": 999.0, "disc": 0.0, "snr": 99.0}, 0)]) == [(9, "snr above 20.0")] and run([(9, {"loss": 999.0, "disc": 0.0}, 0)]) == [(9, "disc below 0.01")]  # order
    assert run([(9, {"loss": None, "snr": math.nan, "disc": math.inf}, 0), (10, {}, 0)]) == []
    assert run([(9, {}, 4.9), (10, {}, 5.0)]) == [(10, "budget")] and run([(9, {}, 1e9)], Rules()) == []


def test_streak():
    bad = {"grad_norm": math.nan}
    assert run([(i, bad, 0) for i in range(5)]) == [(2, "non-finite for 3 steps")]  # before warm-up too
    assert run([(1, bad, 0), (2, bad, 0), (3, {"grad_norm": 1.0}, 0), (4, bad, 0), (5, bad, 0)]) == []
    assert run([(1, bad, 0), (2, bad, 0), (3, {}, 0), (4, bad, 0), (5, bad, 0)]) == []  # a missing value ends it
    assert run([(i, {"loss": math.inf}, 0) for i in range(9)]) == []  # other metrics do not count
    assert run([(9, {"grad_norm": math.inf, "loss": 999.0}, 0), (10, {"grad_norm": 1.0, "loss": 999.0}, 0)]) == [(10, "loss above 100.0")]  # nothing else is judged


def test_stream_equals_batch(spark, tmp_path):
    schema = "run string, step long, hours double, metrics map<string,double>"
    rows = [(f"r{k}", s, s / 100, {"loss": 120.0 if (k, s) == (1, 7) else 1.0, "disc": 0.0 if k == 2 and s > 8 else 9.0}) for k in range(3) for s in range(20)]
    source = tmp_path / "in"
    for part in range(2):  # two micro-batches, the second in reverse order of steps
        half = [r for r in rows if (r[1] >= 10) == bool(part)]
        spark.createDataFrame(half[::-1], schema).coalesce(1).write.json(str(source / f"b{part}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(source))
    query = guard_stream(stream, RULES).writeStream.format("memory").queryName("halts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.run, r.step, r.reason) for r in spark.table("halts").collect()}
    want = {(f"r{k}", *hit) for k in range(3) for hit in run([(s, m, h) for r, s, h, m in rows if r == f"r{k}"])}
    assert got == want and len(got) == 2


def test_windowed_means(spark):
    df = spark.createDataFrame([("a", s, float(s)) for s in range(1, 12)], "metric string, step long, value double")
    assert sorted((r.block, r["mean"]) for r in windowed_means(df, 5).collect()) == [(0, 3.0), (1, 8.0)] and windowed_means(df.filter(F.lit(False)), 5).count() == 0
