import pytest
from loomspark.sources.places import resolve
from loomspark.streaming.follow import follow, kept_up, until


def test_lines_are_followed_across_restarts(spark, tmp_path):
    source, out, mark = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    (source / "a.log").write_text("one\ntwo\n")
    assert not until(kept_up(follow(spark, str(source)), out, mark, 0.01), 0.15)
    (source / "b.log").write_text("three\n")
    assert not until(kept_up(follow(spark, str(source)), out, mark, 0.01), 0.15)
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == ["one", "three", "two"]


def test_places(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.txt").write_text("x")
    whole = str(tmp_path / "deep" / "x.txt")
    assert resolve(spark, whole) == whole and resolve(spark, "store:deep/x.txt", {"store": str(tmp_path)}) == whole
    assert resolve(spark, f"file://{whole}") == f"file://{whole}"
    for path in ("store:deep/y.txt", str(tmp_path / "none")):
        with pytest.raises(FileNotFoundError):
            resolve(spark, path, {"store": str(tmp_path)})
