"""Change feeds with timers and the head as state, into an index, exactly once."""

import time

from pyspark.sql import functions as F

from lanternfish.jobs.index import Index
from lanternfish.streaming import watch

EVENTS = "ts timestamp, project string, src_path string, is_directory boolean, head string"


def put(spark, folder, *rows):
    """Events, all in one file of a stream: (path, head)."""
    events = spark.createDataFrame([("p", path, False, head) for path, head in rows], "project string, src_path string, is_directory boolean, head string")
    events.withColumn("ts", F.current_timestamp()).select(*(c.split()[0] for c in EVENTS.split(", "))).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, **more):
    return watch.debounced_by_timer(watch.relevant(spark.readStream.schema(EVENTS).parquet(str(folder))), "project", "src_path", "head", **more)


def wait(test, seconds=60):
    until = time.time() + seconds
    while not test() and time.time() < until:
        time.sleep(0.2)
    return test()


def test_a_last_run_needs_no_later_event(spark, tmp_path):
    put(spark, tmp_path / "in", ("/r/a.py", None), ("/r/b.py", None), ("/r/a.py", None), ("/r/.git/HEAD", None), ("/r/notes.txt", None))
    seen = []
    query = stream(spark, tmp_path / "in").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").foreachBatch(lambda rows, n: seen.extend(rows.collect())).start()
    try:
        assert wait(lambda: seen)
        assert [(r.project, r.paths, r.n_events, r.moved) for r in seen] == [("p", ["/r/a.py", "/r/b.py"], 3, False)]
    finally:
        query.stop()


def test_a_full_run_comes_out_at_once(spark, tmp_path):
    put(spark, tmp_path / "in", *((f"/r/f{k}.py", None) for k in range(30)))
    seen = []
    query = stream(spark, tmp_path / "in", gap_ms=3_600_000, full=10).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").foreachBatch(lambda rows, n: seen.extend(rows.collect())).start()
    try:
        assert wait(lambda: seen)
    finally:
        query.stop()
    assert sorted(p for r in seen for p in r.paths) == sorted(f"/r/f{k}.py" for k in range(30)) and sum(r.n_events for r in seen) == 30


def test_head_survives_a_restart_and_batches_count_once(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    code = "def {0}():\n    a = 1\n    b = 2\n    return a + b\n"
    for name in ("one", "two"):
        (root / f"{name}.py").write_text(code.format(name))
    index = Index(spark, str(root), str(tmp_path / "store"), parts=4)
    calls, follow = [], index.follow

    def counted(paths, stream, number):
        done = follow(paths, stream, number)
        calls.append((paths, number, done))
        return done

    index.follow = counted

    def started():
        return watch.follow(index, stream(spark, tmp_path / "in"), str(tmp_path / "check"), processingTime="200 milliseconds")

    put(spark, tmp_path / "in", (f"{root}/one.py", "a"))
    query = started()
    try:
        assert wait(lambda: calls)
    finally:
        query.stop()
    assert calls[0][0] == [f"{root}/one.py"] and [r.symbol_id for r in index.symbols().collect()] == ["one.py::one"]
    # another head after the restart: the whole tree, once
    put(spark, tmp_path / "in", (f"{root}/one.py", "b"))
    query = started()
    try:
        assert wait(lambda: len(calls) == 2)
        put(spark, tmp_path / "in", (f"{root}/one.py", "b"))
        assert wait(lambda: len(calls) == 3)
    finally:
        query.stop()
    assert [paths for paths, *_ in calls] == [[f"{root}/one.py"], None, [f"{root}/one.py"]]
    assert calls[1][2]["new"] == 1 and index.symbols().count() == 2
    version = index.store.latest().number
    assert follow(None, "watch", calls[1][1]) == {"already_done": 1} and index.store.latest().number == version
    assert follow(None, "other", 0)["same"] == 2
