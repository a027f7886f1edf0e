"""Streams against their batch twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from shelfmark.operators import audit as A
from shelfmark.operators import order_log as L
from shelfmark.operators import orders as O
from shelfmark.plans import domain as D
from shelfmark.plans import q_trajectories as Q
from shelfmark.streaming import stateful as S
from shelfmark.streaming import windows as W


def as_stream(spark, df, path, files=1):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def drain(stream, name, path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return stream.sparkSession.table(name)


def test_progress_stream_equals_batch(spark, sf, tmp_path):
    events = Q.progress_events(spark, sf)
    src = events.withColumn("conv", F.col("user_id").cast("string")).drop("user_id").coalesce(1)
    out = drain(S.task_progress(as_stream(spark, src, tmp_path / "in")), "progress_out", tmp_path / "cp")
    got = {(r["conv"], r["seq"]): json.loads(r["facts"]) for r in out.collect()}
    want = Q.facts(spark, sf).collect()
    assert len(got) == len(want)
    for r in want:
        f = got[(str(r["user_id"]), r["seq"])]
        for k in ("return_intent", "order_id", "verification_available", "identity_verified", "order_loaded", "eligibility", "return_reason", "confirmation", "return_created", "blocked_by", "handed_off"):
            assert f[k] == r[k], (r["user_id"], r["seq"], k)


def test_order_stream_equals_batch(spark, sf, tmp_path):
    c, orders = D.basket_commands(spark, sf).coalesce(1), D.order_baskets(spark, sf)
    stream = as_stream(spark, c, tmp_path / "in")
    out = drain(S.order_commands(stream, orders, D.users(spark, sf), D.AS_OF), "orders_out", tmp_path / "cp")
    cols = ["seq", "order_id", "tool", "ok", "changed", "idempotent_replay", "error", "version"]
    batch = L.apply_log(c, orders, D.users(spark, sf), D.AS_OF).where(F.col("version").isNotNull())
    assert sorted(map(str, out.select(cols).collect())) == sorted(map(str, batch.select(cols).collect()))


def test_audit_stream_equals_batch(spark, sf, tmp_path):
    m = Q.audit_messages(spark, sf)
    ends = m.groupBy("sim").agg(F.max("pos").alias("pos")).select(
        "sim", (F.col("pos") + 1).alias("pos"), F.lit("end").alias("role"), F.lit(None).cast("string").alias("content"), F.lit(False).alias("error")
    )
    src = m.unionByName(ends, allowMissingColumns=True).coalesce(1)
    q = S.process_audit(as_stream(spark, src, tmp_path / "in"), lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}")))
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {r["simulation_id"]: sorted(r["violations"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["simulation_id"]: sorted(r["violations"]) for r in A.verdicts(m, A.audit(m, block_size=50)).collect()}
    assert got == want


def test_first_reviews_and_duplicates(spark, tmp_path):
    rows = [("A", "x" * 30, i) for i in range(8)] + [("A", "short", 9), ("B", "y" * 40, 10), ("Z", "z" * 40, 11)]
    df = spark.createDataFrame(rows, "source_asin string, body string, line_no bigint").coalesce(1)
    known = spark.createDataFrame([("A",), ("B",)], "source_asin string")
    out = drain(S.first_reviews(as_stream(spark, df, tmp_path / "in"), known), "reviews_out", tmp_path / "cp").collect()
    assert sorted((r["source_asin"], r["line_no"]) for r in out) == [("A", 0), ("A", 1), ("A", 2), ("A", 3), ("A", 4), ("B", 10)]
    sims = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "simulation_id string, t int").withColumn("ts", F.timestamp_seconds("t"))
    kept = drain(S.drop_duplicate_simulations(as_stream(spark, sims, tmp_path / "in2"), "ts", "1 hour"), "sims_out", tmp_path / "cp2")
    assert sorted(r["simulation_id"] for r in kept.collect()) == ["s1", "s2"]


def test_upserts_and_windows(spark, sf, tmp_path):
    src = D.table(spark, sf, "events").select(F.col("user_id").alias("trajectory_id"), F.col("event_id").alias("version"), "value")
    stream = as_stream(spark, src, tmp_path / "in", files=3)
    q = S.trajectory_upserts(stream, str(tmp_path / "store"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "store"))
    want = src.groupBy("trajectory_id").agg(F.max("version").alias("version"))
    assert sorted(map(tuple, got.select("trajectory_id", "version").collect())) == sorted(map(tuple, want.collect()))
    calls = D.calls(spark, sf).withColumn("started_at", F.col("started_at").cast("timestamp"))
    cs = as_stream(spark, calls, tmp_path / "calls")
    out = drain(W.call_metrics(cs, "1 hour", watermark="10 minutes"), "calls_out", tmp_path / "cp3", "update")
    total = out.groupBy("window_start", "tool").agg(F.max("calls").alias("calls")).agg(F.sum("calls")).first()[0]
    assert total == calls.count()
    ss = drain(W.sessions(cs, "user_id", "120 minutes", watermark="10 minutes"), "sess_out", tmp_path / "cp4")
    assert ss.count() <= W.sessions(calls, "user_id", "120 minutes").count()


def two_triggers(stream_of, first, second, path):
    """Feed one file, then another, so that the second trigger sees the first one's state."""
    spark = first.sparkSession
    first.coalesce(1).write.parquet(str(path / "in"))
    for batch in (first, second):
        if batch is second:
            second.coalesce(1).write.mode("append").parquet(str(path / "in"))
        writer = stream_of(spark.readStream.schema(first.schema).parquet(str(path / "in")))
        q = writer.option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(90)


def to_folder(path):
    return lambda df, n: df.write.mode("overwrite").parquet(str(path / f"out/b={n}"))


def test_late_progress_events_are_reported_and_not_applied(spark, sf, tmp_path):
    events = Q.progress_events(spark, sf).withColumn("conv", F.col("user_id").cast("string")).drop("user_id")
    conv = events.groupBy("conv").count().orderBy(F.desc("count"), "conv").first()["conv"]
    one = events.where(F.col("conv") == conv).persist()
    low, high = one.agg(F.min("seq"), F.max("seq")).first()
    middle = (low + high) // 2
    late = one.where(F.col("seq") == low).withColumn("content", F.lit("I want to return O99999, my code is 0000"))
    two_triggers(lambda s: S.task_progress(s).writeStream.foreachBatch(to_folder(tmp_path)), one.where(F.col("seq") <= middle), one.where(F.col("seq") > middle).unionByName(late), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert [r.seq for r in got.where("late").collect()] == [low]
    want = {r["seq"]: r["order_id"] for r in Q.facts(spark, sf).where(F.col("user_id").cast("string") == conv).collect()}
    assert {r.seq: json.loads(r.facts)["order_id"] for r in got.where("not late").collect()} == want


def test_late_messages_and_commands(spark, sf, tmp_path):
    m = Q.audit_messages(spark, sf)
    sim = m.select("sim").orderBy("sim").first()["sim"]
    one = m.where(F.col("sim") == sim)
    end = one.groupBy("sim").agg(F.max("pos").alias("pos")).select("sim", (F.col("pos") + 1).alias("pos"), F.lit("end").alias("role"), F.lit(None).cast("string").alias("content"), F.lit(False).alias("error"))
    whole = one.unionByName(end, allowMissingColumns=True)
    two_triggers(lambda s: S.completed_simulations(s).writeStream.foreachBatch(to_folder(tmp_path)), whole, one.limit(1), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("not late").count() == one.count() and got.where("late").count() == 1
    c = D.commands(spark, sf)
    joined = S.order_commands  # the last command of an order, then an earlier one
    orders, users = D.orders(spark, sf), D.users(spark, sf)
    live = O.with_records(c.where(F.col("tool").isin(O.WRITE_TOOLS)), orders, users).withColumn("static", O.static_error(D.AS_OF)).where(F.col("static").isNull())
    order = live.groupBy("order_id").count().where("count > 1").orderBy("order_id").first()["order_id"]
    times = sorted((r.ts, r.seq) for r in live.where(F.col("order_id") == order).select("ts", "seq").collect())
    mine = c.where(F.col("order_id") == order)
    folder = tmp_path / "orders"
    two_triggers(lambda s: joined(s, orders, users, D.AS_OF).writeStream.foreachBatch(to_folder(folder)), mine.where(F.col("seq") == times[-1][1]), mine.where(F.col("seq") == times[0][1]), folder)
    out = spark.read.parquet(str(folder / "out")).collect()
    assert [(r.seq, r.error) for r in out if r.late] == [(times[0][1], "late_event")] and len(out) == 2


def test_upserts_write_only_touched_buckets(spark, tmp_path):
    rows = [(i, 1, float(i)) for i in range(200)]
    first = spark.createDataFrame(rows, "trajectory_id bigint, version int, value double")
    second = spark.createDataFrame([(7, 2, 70.0)], first.schema)
    seen = []

    def stream_of(s):
        seen.append({p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")})
        return S.trajectory_upserts(s, str(tmp_path / "store"), str(tmp_path / "cp"))

    two_triggers(stream_of, first, second, tmp_path)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    changed = {p.parent.name for p in set(seen[1]) ^ set(after)}
    assert len(changed) == 1
    got = {r.trajectory_id: (r.version, r.value) for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert got == {i: (2, 70.0) if i == 7 else (1, float(i)) for i in range(200)}


def test_rows_dropped_by_the_watermark_are_counted(spark, tmp_path):
    schema = "started_at timestamp, tool string, ok boolean, latency_ms double, seq bigint, user_id int"

    def calls(*minutes):
        rows = [(m, "t", True, 1.0, i, 1) for i, m in enumerate(minutes)]
        return spark.createDataFrame(rows, schema.replace("started_at timestamp", "started_at int")).withColumn("started_at", F.timestamp_seconds(F.col("started_at") * 60))

    for name, build in {"tumbling": lambda s: W.call_metrics(s, "10 minutes", watermark="5 minutes"), "sessions": lambda s: W.sessions(s, "user_id", "10 minutes", watermark="5 minutes")}.items():
        folder, seen = tmp_path / name, W.DroppedRows()
        counts = []
        for turn, minutes in enumerate([(0, 100), (200,), (1, 40, 201)]):
            calls(*minutes).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            q = build(spark.readStream.schema(schema).parquet(str(folder / "in"))).writeStream.format("noop").outputMode("append")
            q = q.option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
            assert q.awaitTermination(90)
            counts.append(seen.read(q))
            assert seen.read(q) == counts[-1]
        assert counts == [0, 0, 2], (name, counts)
