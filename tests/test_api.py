import wave

from pyspark.sql import functions as F

import loomspark
from loomspark import api, cli, jobs
from loomspark.functions import persian
from loomspark.plans.language import ENTITIES, PHRASES
from loomspark.sources import files


def test_plain_equals_column(spark):
    texts = [*PHRASES, *ENTITIES, "ا\u0653ب و \u0627\u0654", "e\u0301 é", "می\u200cروم \u200c ها", "خانه  هایی ،دور!!", "؟!", "می\u00a0روم", "a\u2003b…", "کتاب ها\nی خوب تر", "[x] {y}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    got = {r.id: r.n for r in df.select("id", persian.normalised(F.col("s")).alias("n")).collect()}
    assert got == {i: api.normalize(t) for i, t in enumerate(texts)}
    bare = {r.id: r.n for r in df.select("id", persian.normalised(F.col("s"), spelled=False).alias("n")).collect()}
    assert bare == {i: api.normalize(t, spelled=False) for i, t in enumerate(texts)}


def test_entry_points(capsys):
    assert loomspark.normalize("كتاب  هاي خوب را مي خوانم...") == f"کتاب{persian.ZWNJ}های خوب را می{persian.ZWNJ}خوانم."
    assert loomspark.phonemize("سلام!") == "sal1Am !" and loomspark.text_to_ids("سلام")[0] == 1 and api.to_ipa("sh1A") == "ʃˈɒː"
    assert cli.main(["normalize", "۵٪"]) == 0 and capsys.readouterr().out == "پنج درصد\n"
    assert cli.main(["phonemize", "--ipa", "سلام"]) == 0 and "ɒː" in capsys.readouterr().out
    assert cli.main(["bench", "سلام", "--runs", "2"]) == 0


def test_audit_and_manifest(spark, tmp_path):
    source = spark.range(600).selectExpr("id AS idx", "concat('سلام دنیا ', repeat('ب', cast(id % 9 AS int))) AS sentence", "1.0 + id % 10 AS duration", "if(id % 5 = 0, null, 3.5D) AS mos_ovr")
    source.write.parquet(str(tmp_path / "in"))
    manifest = jobs.audit(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    row = manifest.filter("idx = 1").first()
    assert (row.n_chars, row.n_words, row.n_letters, row.letters_per_sec, row.has_latin) == (11, 3, 9, 4.5, False)
    clusters = spark.range(600).selectExpr("id AS idx", "id % 30 AS cluster")
    bounds = {"mos": "mos_ovr", "least": 3.0, "duration": "duration", "shortest": 0.0, "longest": 99.0}
    report = jobs.build_manifest(manifest, clusters, str(tmp_path / "split"), bounds, bounds, clips=60, speakers=5)
    assert report["eval"]["clips"] > 0 and report["eval"]["speakers"] <= 5
    held = {r.cluster for r in spark.read.json(str(tmp_path / "split/eval")).collect()}
    assert not held & {r.cluster for r in spark.read.json(str(tmp_path / "split/tier_a")).collect()}


def test_verify(spark):
    out = jobs.verify(spark.createDataFrame([(x / 10,) for x in range(11)], "cer double"))
    assert out["percentiles"][2] == 0.5 and abs(out["0.3"] - 4 / 11) < 1e-12


def test_lexicon_and_wav(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("b\tx\ty\n# c\n\na\tz\nb\ty\tw\n", encoding="utf-8")
    got = {r.key: r.readings for r in files.lexicon(spark, str(tmp_path / "lex.tsv")).collect()}
    assert got == {"a": ["z"], "b": ["x", "y", "w"]}
    with wave.open(str(tmp_path / "t.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\x00\x40\x00\x40" * 4000)
    df = spark.createDataFrame([(1, (tmp_path / "t.wav").read_bytes()), (2, b"junk"), (3, None)], "idx long, audio binary")
    head = {r.idx: (r.duration, r.sample_rate, r.format) for r in files.wav_header(df).collect()}
    assert head == {1: (0.5, 8000, "WAV"), 2: (None, None, None), 3: (None, None, None)}
    assert [(r.idx, len(r.samples), r.samples[0]) for r in files.wav_samples(df, 8000).collect()] == [(1, 4000, 0.5)] and files.wav_samples(df, 16000).count() == 0


def test_golden_with_a_lexicon_of_ones_own(spark, tmp_path, capsys):
    (tmp_path / "g.tsv").write_text("# id\n1\tezafe\tباد خوش\tb1Ad- x1osh\n?2\tgeneral\tباد\tb1Ad\n3\tgeneral\tباد\tb1od\n", encoding="utf-8")
    (tmp_path / "l.tsv").write_text("باد\tbAd\nخوش\txosh\n", encoding="utf-8")
    got = {r.category: (r.n, round(r.exact, 3), r.tp, r.fp, r.fn) for r in jobs.evaluate_golden(spark, str(tmp_path / "g.tsv"), str(tmp_path / "l.tsv")).collect()}
    assert got == {"overall": (3, 0.667, 1, 0, 0), "ezafe": (1, 1.0, 1, 0, 0), "general": (2, 0.5, 0, 0, 0)}
    assert cli.main(["evaluate", str(tmp_path / "g.tsv"), "--lexicon", str(tmp_path / "l.tsv")]) == 0 and "overall" in capsys.readouterr().out


def test_lexicon_lines_of_any_length(spark, tmp_path):
    (tmp_path / "long.tsv").write_text("w\t" + "\t".join(f"r{i}" for i in range(2_500)) + "\n", encoding="utf-8")
    (row,) = files.lexicon(spark, str(tmp_path / "long.tsv")).collect()
    assert row.readings == [f"r{i}" for i in range(2_500)]
