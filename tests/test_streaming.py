"""Streams against their batch definitions."""

import time

from pyspark.sql import functions as F

from lodestone.sources import tables as T
from lodestone.sources.views import progress
from lodestone.streaming import ingest
from lodestone.streaming import progress as R


def _source(spark, sf_dir, tmp_path):
    rows = progress(spark, sf_dir)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))


def test_latest_by_batches(spark, sf_dir, tmp_path):
    rows, stream = _source(spark, sf_dir, tmp_path)
    q = R.write_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["task_id"])
    assert q.awaitTermination(120)
    got = R.latest(spark.read.parquet(str(tmp_path / "out")).drop("batch_id"), ["task_id"])
    want = R.latest(rows, ["task_id"])
    assert {(r.task_id, r.status, r.ts) for r in got.collect()} == {(r.task_id, r.status, r.ts) for r in want.collect()}


def test_latest_by_state(spark, sf_dir, tmp_path):
    rows, stream = _source(spark, sf_dir, tmp_path)
    q = R.latest_stream(stream).writeStream.outputMode("update").format("memory").queryName("latest_state").option("checkpointLocation", str(tmp_path / "cp")).start()
    want = {(r.task_id, r.status, r.event_id) for r in R.latest(rows, ["task_id"]).collect()}
    try:
        for _ in range(90):
            got = spark.sql("select task_id, max_by(struct(status, event_id), struct(ts, event_id)) s from latest_state group by 1").collect()
            if {(r.task_id, r.s.status, r.s.event_id) for r in got} == want:
                break
            time.sleep(1)
        else:
            raise AssertionError("the stream did not come to the batch result")
    finally:
        q.stop()


def test_ingest_sends_broken_bodies_aside(spark, tmp_path):
    ok = '{"task_id":"t1","file_path":"/in/a.txt","metadata":{},"user_info":{"passport_data":{"user_id":3,"groups":[2],"total_roles":[1]}}}'
    spark.createDataFrame([(ok,), ("{broken",), ('{"file_path":"x"}',)], "value string").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    q = ingest.start(stream, lambda df, run: seen.append((run, [r.task_id for r in df.collect()])), str(tmp_path / "dead"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert seen == [("run-0", ["t1"])]
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 2
    row = ingest.decode(spark.createDataFrame([(ok,)], "value string")).first()
    assert (row.pipeline_separation, row.title, row.file_type, row.category, row.chunk_size, row.group_id) == (True, "a", "txt", "general", 500, 2)


def test_counted_writes_and_raw_files(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("group_id"))
    assert T.write_counted(df, str(tmp_path / "t"), expected=10) == 10
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "A.TXT").write_bytes(b"abc")
    r = T.raw_files(spark, str(tmp_path / "files")).first()
    assert (r.filename, r.extension, r.file_size, r.hash_sha256[:8]) == ("A.TXT", "txt", 3, "ba7816bf")
    T.append(df, str(tmp_path / "p"))
    assert T.scan(spark, str(tmp_path / "p"), "group_id = 1", ["id"]).count() == 5


def test_running_sets_by_state(spark, sf_dir, tmp_path):
    rows, stream = _source(spark, sf_dir, tmp_path)
    q = R.running_stream(stream, ["user_id", "category"]).writeStream.outputMode("update").format("memory").queryName("running_state").option("checkpointLocation", str(tmp_path / "cp")).start()
    want = {(r.user_id, r.category): r.tasks for r in R.running_by_category(rows).collect()}
    try:
        for _ in range(90):
            seen = {}
            for r in spark.sql("select * from running_state").collect():
                seen[r.user_id, r.category] = r.tasks  # in the order of the batches
            if {k: v for k, v in seen.items() if v} == want:
                break
            time.sleep(1)
        else:
            raise AssertionError("the stream did not come to the batch result")
    finally:
        q.stop()


def _states(spark, sf_dir):
    """Progress of the table's first half, and of its second half, of a few users."""
    rows = progress(spark, sf_dir).where("user_id % 4 = 0").withColumn("user_id", F.col("user_id") % 6)
    half = rows.agg(F.percentile("event_id", F.lit(0.5))).first()[0]
    return rows.where(F.col("event_id") <= half), rows.where(F.col("event_id") > half)


def test_snapshot_then_deltas(spark, sf_dir, tmp_path):
    """After each micro-batch, what a listener was sent says which tasks run, until its end."""
    before, after = _states(spark, sf_dir)
    state = R.latest(before, ["user_id", "task_id"])
    late = after.orderBy("event_id").collect()
    end = [r for r in R.latest(before.union(after), ["user_id", "task_id"]).where("user_id = 0").collect() if r.status not in R.TERMINAL]
    last = [(r.task_id, 0, r.hash_sha256, r.category, r.stage, "completed", r.ts + 10**9, 10**9 + i) for i, r in enumerate(end)]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(after.schema).parquet(str(source))
    heard = []
    q = R.listener_stream(stream, state).writeStream.foreachBatch(lambda b, i: heard.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        seen = before
        for k, rows in enumerate([late[: len(late) // 2], late[len(late) // 2 :], last]):
            new = spark.createDataFrame(rows, after.schema)
            new.coalesce(1).write.mode("append").parquet(str(source))
            seen = seen.union(new)
            want = {}
            for r in R.latest(seen, ["user_id", "task_id"]).where(~F.col("status").isin(*R.TERMINAL)).collect():
                want.setdefault(r.user_id, set()).add((r.task_id, r.stage))
            for _ in range(120):
                said, ended = {}, set()
                for r in list(heard):
                    if r.kind == "end":
                        ended.add(r.user_id)
                    elif r.status in R.TERMINAL:
                        said.setdefault(r.user_id, {}).pop(r.task_id, None)
                    else:
                        said.setdefault(r.user_id, {})[r.task_id] = r.stage
                got = {u: set(t.items()) for u, t in said.items() if t}
                if got == want:
                    break
                time.sleep(0.5)
            else:
                raise AssertionError(f"batch {k}: {got} instead of {want}")
        assert 0 in ended and not ended & set(want)
        first = {}
        for r in heard:
            first.setdefault(r.user_id, r.kind)
        running = {r.user_id for r in state.collect() if r.status not in R.TERMINAL}
        assert running and {first[u] for u in running} == {"snapshot"}
    finally:
        q.stop()


def test_timers_without_events(spark, tmp_path):
    """A terminal task is dead once its time is over, a waiting one not; stale jobs fail by themselves."""
    tasks, work = "task_id string, status string, ts long, event_id long", "id long, status string, event_id long"
    spark.createDataFrame([("a", "completed", 1, 1), ("b", "in_progress", 1, 2)], tasks).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(1, "pending", 1), (2, "pending", 2), (2, "running", 3), (3, "running", 4), (3, "completed", 5)], work).write.parquet(str(tmp_path / "jobs"))
    live = R.liveness_stream(spark.readStream.schema(tasks).parquet(str(tmp_path / "in")), 2)
    reaped = R.reaper_stream(spark.readStream.schema(work).parquet(str(tmp_path / "jobs")), 2, 3)
    heard, failed = [], []
    both = ((live, heard), (reaped, failed))
    queries = [x.writeStream.outputMode("update").foreachBatch(lambda b, i, to=to: to.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / f"cp{k}")).start() for k, (x, to) in enumerate(both)]
    try:
        for _ in range(120):
            if len(heard) >= 3 and len(failed) >= 2:
                break
            time.sleep(0.5)
        time.sleep(3)
        assert sorted(heard) == [("a", False), ("a", True), ("b", True)] and heard.index(("a", False)) > heard.index(("a", True))
        assert sorted(r[:3] for r in failed) == [(1, "failed", "not started in time"), (2, "failed", "not completed in time")]
    finally:
        for q in queries:
            q.stop()


def test_duplicates_on_a_stream(spark, tmp_path):
    """Content that is in flight or registered goes; after the watermark has passed, the same content is new again."""
    schema = "group_id long, hash_sha256 string, ts timestamp, event_id long"
    known = spark.createDataFrame([(1, "known")], "group_id long, hash_sha256 string")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batches = ([(1, "x", "10:00", 1), (2, "x", "10:01", 2), (1, "known", "10:02", 3)], [(1, "x", "10:30", 4), (1, "y", "10:31", 5)], [(1, "z", "14:00", 6)], [(1, "w", "14:01", 7)], [(1, "x", "14:10", 8)])
    seen = []
    q = ingest.without_duplicates(stream, known).writeStream.foreachBatch(lambda b, i: seen.extend(r.event_id for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for rows in batches:
            df = spark.createDataFrame([(g, h, f"2024-01-01 {t}:00", e) for g, h, t, e in rows], "group_id long, hash_sha256 string, ts string, event_id long")
            df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
        assert sorted(seen) == [1, 2, 5, 6, 7, 8]
    finally:
        q.stop()
