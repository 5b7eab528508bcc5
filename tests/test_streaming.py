import datetime as dt

import pytest

from quillon.streaming import state as V

T0 = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, rows, schema):
    """A stream of one file for each batch, in order."""
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    # One that waits for idle keys never ends by itself.
    query.stop()
    return stream.sparkSession.table(name).collect()


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_debounce_and_throttle(spark, tmp_path):
    rows = [[("k", at(0), "a"), ("k", at(1), "b"), ("k", at(30), "c")], [("k", at(500), "z")]]
    schema = "key string, ts timestamp, v string"
    stream = feed(spark, tmp_path, rows, schema)
    got = run(V.debounced(stream, "key", "ts", "v", "5 seconds", "10 seconds"), tmp_path)
    assert {(r.v, r.n) for r in got} == {("b", 2), ("c", 1)}
    other = tmp_path / "o"
    other.mkdir()
    got = run(V.throttled(feed(spark, other, rows, schema), "key", "ts", "v", "10 seconds", "10 seconds"), other)
    assert {(r.leading, r.trailing) for r in got} == {("a", "b"), ("c", "c")}


def test_scores_count_once(spark, tmp_path):
    rows = [[(1, "x", at(0), True), (1, "x", at(1), True)], [(1, "x", at(2), True), (2, "x", at(3), True), (1, "y", at(3), False)]]
    stream = feed(spark, tmp_path, rows, "question int, client string, ts timestamp, correct boolean")
    got = run(V.scores(stream, "ts", "1 hour"), tmp_path, "complete")
    assert {(r.client, r.score) for r in got} == {("x", 2)}


def test_once_in_a_row(spark, tmp_path):
    rows = [[("k", at(0), "a"), ("k", at(1), "a"), ("k", at(2), "b")], [("k", at(3), "b"), ("k", at(4), "a")]]
    got = run(V.once_in_a_row(feed(spark, tmp_path, rows, "key string, ts timestamp, v string"), "key", "ts", "v"), tmp_path)
    assert sorted((r.ts, r.v) for r in got) == [(at(0), "a"), (at(2), "b"), (at(4), "a")]


def test_counters(spark, tmp_path):
    rows = [[("k", at(0), "start", 10.0, 0.0), ("k", at(3), "tick", None, None)], [("k", at(4), "pause", None, None), ("k", at(60), "start", 10.0, 0.0), ("k", at(63), "tick", None, None), ("k", at(70), "tick", None, None), ("k", at(71), "tick", None, None)]]
    got = run(V.counters(feed(spark, tmp_path, rows, "key string, ts timestamp, action string, start double, end double"), "key", "ts"), tmp_path)
    assert sorted((r.ts, r.value, r.ended) for r in got) == [(at(3), 7.0, False), (at(63), 3.0, False), (at(70), 0.0, True)]


def test_upsert_and_fan_out(spark, tmp_path):
    from quillon.sources.files import latest_rows

    rows = [[(1, "a"), (2, "b")], [(1, "a"), (2, "c")]]
    stream = feed(spark, tmp_path, rows, "id int, v string")
    V.upsert(stream, str(tmp_path / "out"), "id", str(tmp_path / "c")).awaitTermination(120)
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.count() == 3 and {(r.id, r.v) for r in latest_rows(table, "id").collect()} == {(1, "a"), (2, "c")}
    seen = []
    V.fan_out(stream, str(tmp_path / "f"), lambda b: seen.append(b.count()), lambda b: seen.append(-b.count())).awaitTermination(120)
    assert seen == [2, -2, 2, -2]


def test_triggered(spark, tmp_path):
    actions = spark.createDataFrame([("go", "start"), ("go", "log")], "activation string, action string")
    got = run(V.triggered(feed(spark, tmp_path, [[("go", 1), ("stop", 2)]], "activation string, n int"), actions, "activation"), tmp_path)
    assert sorted(r.action for r in got) == ["log", "start"]


@pytest.mark.parametrize("gap", ["5 seconds"])
def test_batch_and_stream_agree(spark, tmp_path, gap):
    from quillon.operators.timelines import debounced

    rows = [("k", at(s), str(s)) for s in (0, 2, 4, 20, 22, 300)]
    batch = {(r.v, r.n) for r in debounced(spark.createDataFrame(rows, "key string, ts timestamp, v string"), ["key"], "ts", "v", gap).collect()}
    stream = run(V.debounced(feed(spark, tmp_path, [rows, [("k", at(9000), "end")]], "key string, ts timestamp, v string"), "key", "ts", "v", gap, "1 second"), tmp_path)
    assert {(r.v, r.n) for r in stream} == batch
