from datetime import date

from lodestrata.operators import sinks


def test_summaries_and_marks(spark, tmp_path):
    df = spark.createDataFrame([("a/x.TXT", "text/plain; a=b"), ("b/y.txt", None), ("c/.hidden", "text/plain"), ("d/noext", "TEXT/PLAIN"), ("a/x.TXT", "text/plain")], "path string, kind string")
    assert not sinks.finished(spark, str(tmp_path / "out" / "types"))
    sinks.summaries(df, "path", "kind", str(tmp_path / "out"))
    assert sinks.finished(spark, str(tmp_path / "out" / "types"))
    read = lambda n: [tuple(r) for r in spark.read.csv(str(tmp_path / "out" / n), header=True).collect()]
    assert read("types") == [("text/plain", "4"), ("application/octet-stream", "1")]
    assert read("extensions") == [("TXT", "2"), ("txt", "1")]
    assert spark.read.text(str(tmp_path / "out" / "paths")).count() == 4


def test_lists_and_retention(spark, tmp_path):
    df = spark.createDataFrame([("one", "http://a"), ("two", "http://b"), ("one", "http://c")], "name string, url string")
    sinks.lists(df, "name", "url", str(tmp_path / "lists"))
    sinks.lists(df, "name", "url", str(tmp_path / "lists"))
    assert spark.read.text(str(tmp_path / "lists")).where("list = 'one'").count() == 4
    days = spark.createDataFrame([("2024-03-01", 1), ("2024-03-05", 2)], "day string, n int")
    days.write.partitionBy("day").parquet(str(tmp_path / "days"))
    assert sinks.drop_expired(spark, str(tmp_path / "days"), "day", date(2024, 3, 6), 2) == ["day=2024-03-01"]
    assert spark.read.parquet(str(tmp_path / "days")).count() == 1


def test_after_expansion():
    assert [sinks.after_expansion(a, r) for a, r in ((True, True), (False, True), (False, False))] == ["archive", "remove", "keep"]


def test_clean_up_and_marks(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    at = lambda n: str(tmp_path / n)
    assert sinks.clean_up(spark, [at("a")], at("archive"), True) == {at("a"): "archive"} and (tmp_path / "archive" / "a").exists() and not (tmp_path / "a").exists()
    assert sinks.clean_up(spark, [at("b")], None, True) == {at("b"): "remove"} and not (tmp_path / "b").exists()
    assert sinks.clean_up(spark, [at("c")], None, False) == {at("c"): "keep"} and (tmp_path / "c").exists()
    for _ in range(2):
        sinks.mark(spark, at("status"), "ingest_done", "2024-03-01")
    assert spark.read.parquet(at("status")).count() == 1
