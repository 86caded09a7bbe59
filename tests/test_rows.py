import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import dedupe, ingest, outcome
from lodestrata.plans import search
from lodestrata.sources import lines
from lodestrata.streaming import tail


def test_first_and_last_win(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), ("a", 3, "z")], "k string, n int, v string")
    assert {tuple(r) for r in dedupe.first_wins(df, "k", "n").collect()} == {("a", 1, "y"), ("b", 1, None)}
    assert {tuple(r) for r in dedupe.last_wins(df, "k", "n").collect()} == {("a", 3, "z"), ("b", 1, None)}
    assert dedupe.first_wins(df.limit(0), "k", "n").count() == 0
    new = spark.createDataFrame([("a", 9, "new")], df.schema)
    assert {r.k: r.n for r in ingest.upserted(dedupe.last_wins(df, "k", "n"), new, "k").collect()} == {"a": 9, "b": 1}


def test_stage_and_retry(spark):
    df = spark.createDataFrame([(True, False, [500, 200]), (False, False, [500] * 6 + [200]), (True, True, [400])], "running boolean, ingest_done boolean, tries array<int>")
    got = df.select(outcome.stage({"running": F.col("running"), "ingest_done": F.col("ingest_done")}), outcome.retry_outcome(F.col("tries"))).collect()
    assert [tuple(r) for r in got] == [("downloading", 200), ("waiting", None), ("finished", 400)]


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The Contract and the delivery"), (2, "contract contract"), (3, ""), (4, None), (5, "contractor"), (6, "contract contract")], "doc int, text string")
    where = str(tmp_path / "index")
    post = search.indexed(docs, "doc", "text", where)
    total = search.totals(spark, where)
    ids = lambda df: {r.doc for r in df.collect()}
    assert ids(search.match(post, "contract delivery")) == {1, 2, 6}
    assert ids(search.match(post, "contract delivery", every=True)) == {1}
    assert ids(search.prefix(post, "contract")) == {1, 2, 5, 6}
    assert ids(search.phrase(post, "the delivery")) == {1}
    assert search.match(post, "nothing").count() == 0 and search.match(post, "").count() == 0
    assert tuple(total.first()) == (5, 10 / 5, 4, 8 / 4)
    ranked = search.top(search.bm25(post, total, "contract delivery", once=True), 2).collect()
    assert [r.doc for r in ranked] == [1, 2] and ranked[0].score > ranked[1].score
    assert [r.doc for r in search.top(search.bm25(post, total, "contract delivery")).collect()] == [1, 2, 6]
    assert [tuple(r) for r in search.cursor(search.bm25(post, total, "contract", once=True)).collect()] == [(1, 2, None, 1), (2, 1, 2, None)]
    assert docs.select(search.snippet(F.col("text"), "contract", 3)).first()[0] == "he Contract an"
    sized = spark.createDataFrame([(1, 2.0, 5), (2, 1.0, 6), (3, 0.5, 1)], "doc int, score double, size int")
    assert ids(search.within(sized, "size", 11)) == {1, 2}


@pytest.mark.parametrize("ts, want", [("2024-03-01T00:00:10Z", 1709251210), ("1709251210", 1709251210), ("1709251210000", 1709251210), ("nonsense", None), (None, None)])
def test_event_time(spark, ts, want):
    assert spark.createDataFrame([(ts,)], "ts string").select(F.unix_timestamp(tail.event_time(F.col("ts")))).first()[0] == want


def test_stream_twice_on_one_checkpoint(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    line = lambda n: json.dumps({"ts": f"2024-03-01T00:00:{n:02}Z", "level": "info", "component": "c", "sha256": None, "status": "201", "ms": n})
    (tmp_path / "in" / "a.json").write_text(line(1) + "\nnot json\n" + line(2)[:20] + "\n\n")
    run = lambda: tail.sink(tail.records(tail.lines(spark, source, "docker")), out, mark).awaitTermination(60)
    run()
    assert spark.read.parquet(out).count() == 1
    (tmp_path / "in" / "b.json").write_text(line(3) + "\n" + line(4) + "\n")
    run()
    run()
    got = spark.read.parquet(out)
    assert got.count() == 3 and {r.status for r in got.collect()} == {201}
    assert {r.n for r in tail.tumbling(got, "at", "1 minute", "component").collect()} == {3}


def test_windowed_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-03-01T0{h}:10:00Z", "component": "c"}) for h in (0, 0, 1, 5)))
    stream = tail.tumbling(tail.records(tail.lines(spark, str(tmp_path / "in"))), "at", "1 hour", "component", late="1 hour")
    tail.sink(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.n for r in got.collect()) in ([1, 2], [2], [1, 1, 2])


def test_phrases_match_whole_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one of them"), (2, "one of the men"), (3, "of, the of"), (4, "the of"), (5, None)], "doc int, text string")
    post = search.indexed(docs, "doc", "text", str(tmp_path / "i"))
    assert {r.doc for r in search.phrase(post, "of the").collect()} == {2, 3}
    assert {r.doc for r in search.phrase(post, "of the of").collect()} == {3}


def test_scan_is_pruned_by_term(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} other") for i in range(500)], "doc int, text string")
    post = search.indexed(docs, "doc", "text", str(tmp_path / "i"))
    plan = search.match(post, "word3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,word3)]" in plan and "ReadSchema: struct<term:string,doc:int>" in plan
    assert "StringStartsWith(term,wo)" in search.prefix(post, "wo")._jdf.queryExecution().executedPlan().toString()
    assert search.totals(spark, str(tmp_path / "i")).first().n == 500


def test_six_states(spark):
    df = spark.createDataFrame([(True, True, False), (True, False, True), (False, None, None)], "setup boolean, running boolean, downloaded boolean")
    got = df.select(*(c.alias(n) for n, c in outcome.states({x: F.col(x) for x in df.columns}).items())).collect()
    assert [r.download for r in got] == ["RUNNING", "DONE", "NOT RUNNING"] and [r.setup for r in got] == ["DONE", "DONE", "RUN SETUP"] and got[0].ingest == "WAITING FOR FILES"


def test_edges_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("k", "n", "s"), r))) for r in rows))
    stream = lambda: tail.edges(spark.readStream.schema("k string, n int, s string").json(str(tmp_path / "in")), "k", "n", "s", "running", "gone")
    run = lambda: tail.sink(stream(), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    put("a.json", [("x", 1, "running"), ("x", 2, "running"), ("y", 1, "gone"), ("z", 1, "running"), ("z", 2, "gone")])
    run()
    put("b.json", [("x", 3, "gone"), ("x", 4, "gone"), ("y", 2, "running")])
    run()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("z", 2), ("x", 3)}
    rows = spark.createDataFrame([("x", 1, "running"), ("x", 2, "gone"), ("x", 3, "gone")], "k string, n int, s string")
    assert [tuple(r) for r in outcome.edges(rows, "k", "n", F.col("s"), "running", "gone").collect()] == [("x", 2)]


def test_socket_and_minutes(spark, tmp_path):
    import socket
    import threading
    import time

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = server.accept()
        c.sendall(b"one\ntwo\n")
        time.sleep(20)

    threading.Thread(target=serve, daemon=True).start()
    q = tail.sink(tail.socket_lines(spark, "127.0.0.1", server.getsockname()[1], "net"), str(tmp_path / "out"), str(tmp_path / "mark"), every="1 second")
    end = time.time() + 60
    while time.time() < end and not (q.lastProgress and any(p["numInputRows"] for p in q.recentProgress)):
        time.sleep(0.3)
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.value for r in got.collect()} == {"one", "two"} and got.first().tags == ["net"]
    server.close()


def test_members_links_and_empty_lists(spark):
    df = spark.createDataFrame([('{"result": [{"gid": "a"}, {"gid": "b"}]}',), ("{}",), ("no json",), (None,)], "value string")
    assert df.transform(lambda x: lines.members(x, "value")).select(lines.json_field(F.col("item"), "$.gid")).collect() == [("a",), ("b",)]
    page = spark.createDataFrame([('<a href="x.rar">x.rar</a>\n<a href="y.txt">y.txt</a>',), (None,)], "page string")
    assert [r.link for r in lines.links(page, "page", r"\.rar").collect()] == ["x.rar"]
    assert lines.any_line(df) and not lines.any_line(spark.createDataFrame([(" ",), (None,)], "value string"))


def test_appended_and_upserted_rows_are_one_per_key(spark, tmp_path):
    where = str(tmp_path / "docs")
    rows = spark.createDataFrame([("b", "1"), ("a", "1"), ("c", None), ("d", "2")], "filename string, sha256 string")
    assert ingest.append(rows, where) == 2 and ingest.append(rows, where) == 0
    assert {tuple(r) for r in spark.read.parquet(where).select("filename", "sha256").collect()} == {("a", "1"), ("d", "2")}
    old = spark.createDataFrame([("k", 1), (None, 5)], "key string, n int")
    new = spark.createDataFrame([("k", 2), ("k", 3), (None, 9)], "key string, n int")
    assert {tuple(r) for r in ingest.upserted(old, new, "key", "n").collect()} == {("k", 3), (None, 5)}
