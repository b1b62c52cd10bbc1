"""Each keyed stream beside its batch twin, on input that comes in parts, out of order and more than once."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from castlake.operators import details as D
from castlake.streaming import events as E
from castlake.streaming import fold
from castlake.streaming import persist as P
from castlake.streaming import state as S

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


MS = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1000


class Feed:
    """A stream over a folder to which parts are added one by one; what the query sent so far."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, f"{path}/in-{random.getrandbits(60):x}", schema, 0
        (spark.createDataFrame([], schema)).write.json(self.path)
        self.stream = spark.readStream.schema(schema).json(self.path)

    def started(self, df, mode="append", sink=None):
        name = f"q{random.getrandbits(60):x}"
        w = df.writeStream.option("checkpointLocation", f"{self.path}-cp").outputMode(mode)
        self.name, self.query = name, (w.foreachBatch(sink) if sink else w.format("memory").queryName(name)).start()
        return self

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").json(self.path)
        self.query.processAllAvailable()
        return self

    def rows(self):
        return sorted((tuple(r) for r in self.spark.table(self.name).collect()), key=repr)

    def stopped(self):
        self.query.stop()


def sent(feed, df, parts, last, mode="append"):
    """What df sends after parts, and a last row far behind them that moves the watermark."""
    feed.started(df, mode)
    for p in parts:
        feed.add(p)
    feed.add([last])
    out = feed.rows()
    feed.stopped()
    return out


def shuffled_parts(rows, key, reach=4, size=9):
    """rows in the order of key, but each up to `reach` places away, in parts."""
    rnd = random.Random(3)
    rows = sorted(enumerate(sorted(rows, key=key)), key=lambda x: x[0] + rnd.uniform(0, reach))
    rows = [r for _, r in rows]
    return [rows[i : i + size] for i in range(0, len(rows), size)]


LISTING = "path string, at timestamp, scan long, size long, mtime long"


def scans():
    """Files over 12 scans, 10 s apart: one grows, one goes and comes back, one changes, one is touched, one is empty."""
    sizes = {
        "/in/grows": [1, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3],
        "/in/back": [5, 5, 5, 5, None, None, 5, 5, 5, 5, None, 5],
        "/in/once": [None, 7, None, 7, None, 7, None, 7, None, 7, None, 7],
        "/in/changes": [9, 9, 9, 8, 8, 9, 9, 9, 8, 8, 8, 9],
        "/in/empty": [0, 0, 0, 0, 4, 4, 4, None, 0, 0, 0, 0],
    }
    return [(p, at(10_000 * k), k, n, MS // 1000 if n and p != "/in/changes" else 0) for p, x in sizes.items() for k, n in enumerate(x) if n is not None]


def test_files_settle_go_and_settle_anew(spark, tmp_path):
    df = spark.createDataFrame(scans(), LISTING)
    twin = sorted(map(tuple, S.settled_batch(df.withColumn("now", F.unix_seconds("at"))).collect()))
    assert [r for r in twin if r[0] == "/in/back"] == [("/in/back", 5, MS // 1000, 2)] * 2  # settled, gone, back, settled anew
    assert not [r for r in twin if r[0] == "/in/once"]
    by_fold = fold.folded(df.withColumn("now", F.unix_seconds("at")), "path", S.settling(), ["now", "scan", "size", "mtime"])
    assert sorted(map(tuple, by_fold.collect())) == twin
    feed = Feed(spark, tmp_path, LISTING)
    out = sent(feed, S.settled_stream(feed.stream, delay="30 seconds"), shuffled_parts(scans(), lambda r: r[1], 3), ("/in/last", at(10_000_000), 1000, 1, 0))
    assert sorted(out) == twin


def test_state_of_files_that_are_gone_is_dropped(spark, tmp_path):
    """A file is away for longer than gone_ms and comes back in the next scan number: what was known of it is dropped all the same."""
    rows = [("/in/a", at(10_000 * k), k, 5, 0) for k in range(4)]
    feed = Feed(spark, tmp_path, LISTING)
    feed.started(S.settled_stream(feed.stream, gone_ms=60_000)).add(rows).add([("/in/b", at(500_000), 9, 1, 0)]).add([("/in/b", at(510_000), 9, 1, 0)])
    assert [r[0] for r in feed.rows()] == ["/in/a"]
    feed.add([("/in/a", at(520_000 + 10_000 * k), 4 + k, 5, 0) for k in range(4)]).add([("/in/b", at(900_000), 9, 1, 0)])
    assert [r[0] for r in feed.rows()] == ["/in/a", "/in/a"]
    feed.stopped()


def test_settling_rules(spark):
    for sizes, want in (((5, 9, 9, 9, 9), 30), ((9, 9, 9, 9, 9), 20)):
        df = spark.createDataFrame([("f", n, 0, t, t) for n, t in zip(sizes, (0, 1, 10, 20, 30))], "path string, size long, mtime long, now long, polls long")
        step, state, times = S.settling().step, S.UNSEEN, []
        for n, t in zip(sizes, (0, 1, 10, 20, 30)):
            state, out = step(state, (t, None, n, 0))
            times += [t] * len(out)
        assert times == [20 if want == 30 else 10]  # the first sight counts nothing
        assert S.settled_batch(df).count() == 1


def test_throttled(spark, tmp_path):
    schema = "key long, at timestamp, percent double"
    rows = [(k % 3, at(k * 40 + k % 2), float(k * 7 % 101)) for k in range(90)] + [(None, at(5), 1.0), (None, at(7), 100.0)]
    twin = sorted((tuple(r) for r in S.throttled_batch(spark.createDataFrame(rows, schema).withColumn("at_ms", F.unix_millis("at"))).collect()), key=repr)
    assert len(twin) < len(rows)
    feed = Feed(spark, tmp_path, schema)
    out = sent(feed, S.throttled_stream(feed.stream), shuffled_parts(rows, lambda r: r[1]), (9, at(10_000_000), 1.0))
    assert out == twin
    step, last, kept = S.throttle(250).step, (None,), []
    for row in [(0, 1.0), (100, 2.0), (250, 3.0), (300, 100.0)]:
        last, more = step(last, row)
        kept += more
    assert kept == [(0, 1.0), (250, 3.0), (300, 100.0)]
    assert S.throttled_batch(spark.createDataFrame([], "key long, at_ms long, percent double")).count() == 0


def test_a_key_longer_than_a_batch(spark):
    """State goes on from Arrow batch to Arrow batch."""
    ticks = spark.range(60_000).select((F.col("id") % 2).alias("key"), F.col("id").alias("at_ms"), F.lit(0.0).alias("percent"))
    assert S.throttled_batch(ticks, 30).groupBy("key").count().collect() == S.throttled_batch(ticks.repartition(7), 30).groupBy("key").count().collect()
    assert {r["count"] for r in S.throttled_batch(ticks, 30).groupBy("key").count().collect()} == {2000}


def test_job_phases(spark, tmp_path):
    e = [("a", 1, "probing"), ("a", 2, "publishing"), ("a", 3, "planned"), ("a", 4, "encoding"), ("a", 5, "failed"), ("a", 6, "queued")]
    schema = "id string, seq long, phase string, at timestamp"
    r = S.job_phases(spark.createDataFrame(e, "id string, seq long, phase string")).first()
    assert (r.phase, r.applied, r.rejected, r.started, r.finished) == ("queued", 5, 1, 1, 5)
    rnd = random.Random(8)
    names = ["queued", "probing", "planned", "encoding", "validating", "publishing", "completed", "failed", "cancel_requested", "cancelled"]
    rows = [(f"j{rnd.randrange(5)}", k, rnd.choice(names), at(k * 1000)) for k in range(120)]
    twin = sorted(map(tuple, S.job_phases(spark.createDataFrame(rows, schema)).collect()))
    feed = Feed(spark, tmp_path, schema)
    out = sent(feed, S.job_phases_stream(feed.stream), shuffled_parts(rows, lambda r: r[1], 6, 20), ("z", 999, "probing", at(10_000_000)))
    last = {}
    for r in out:
        last[r[0]] = max(last.get(r[0], r), r, key=lambda x: x[2] + x[3])
    assert sorted(last.values()) == twin and len(out) > len(twin)


BEATS = "id string, at timestamp, worker string, ended boolean"


def test_leases_run_out_without_new_input(spark, tmp_path):
    feed = Feed(spark, tmp_path, BEATS)
    feed.started(S.expired_leases_stream(feed.stream, 10_000, "1 second"))
    feed.add([("a", at(0), "w1", False), ("b", at(0), "w2", False), ("c", at(0), "w3", False)]).add([("a", at(8_000), "w1", False), ("c", at(9_000), "w3", True)])
    assert feed.rows() == []
    feed.add([("other", at(20_000), "w", False)]).add([("other", at(25_000), "w", False)])
    assert feed.rows() == [("a", "w1", MS + 18_000), ("b", "w2", MS + 10_000)]  # neither a nor b sent anything more
    feed.stopped()


def test_leases(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(f"j{k % 4}", at(k * 1000), f"w{rnd.randrange(3)}", rnd.random() < 0.2) for k in range(80) if rnd.random() < 0.5]
    df = spark.createDataFrame(rows, BEATS).withColumn("at_ms", F.unix_millis("at"))
    twin = sorted(map(tuple, S.expired_leases(df, 5_000, MS + 10_000_000).collect()))
    assert sorted(map(tuple, fold.folded(df, "id", S.leasing(5_000), ["at_ms", "worker", "ended"], 3).collect())) == sorted(map(tuple, S.expired_leases(df, 5_000, 0).collect()))
    feed = Feed(spark, tmp_path, BEATS)
    assert sent(feed, S.expired_leases_stream(feed.stream, 5_000), shuffled_parts(rows, lambda r: r[1]), ("z", at(10_000_000), "w", True)) == twin


def test_channels(spark, tmp_path):
    schema = "path string, at timestamp"
    found = [("a", at(0)), ("b", at(1000)), ("a", at(5000)), ("c", at(90_000))]
    retried = [("a", at(2000)), ("d", at(3000)), ("b", at(95_000))]
    df = lambda rows: spark.createDataFrame(rows, schema).withColumn("at_ms", F.unix_millis("at") - MS)
    twin = sorted(map(tuple, S.merged_channels(df(found), df(retried), 10_000).collect()))
    assert twin == [("a", 0, "watch"), ("b", 1000, "watch"), ("b", 95_000, "retry"), ("c", 90_000, "watch"), ("d", 3000, "retry")]
    one, two = Feed(spark, tmp_path, schema), Feed(spark, tmp_path, schema)
    one.started(S.merged_channels_stream(one.stream, two.stream, "10 seconds"))
    two.query = one.query
    one.add(found[:2])
    two.add(retried[:2])
    one.add(found[2:])
    two.add(retried[2:])
    assert [(p, int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) - MS, c) for p, t, c in one.rows()] == twin
    one.stopped()


def test_last_lines(spark, tmp_path):
    schema = "key string, seq long, line string, at timestamp"
    rows = [(f"k{k % 3}", k, f"line {k}\r\n" if k % 5 else "\n", at(k * 1000)) for k in range(100)]
    df = S.log_text(spark.createDataFrame(rows, schema))
    twin = {r.key: r.lines for r in S.last_lines(df, 7).collect()}
    assert twin["k0"] == [f"line {k}" for k in range(0, 100, 3) if k % 5][-7:]
    feed = Feed(spark, tmp_path, schema)
    out = sent(feed, S.last_lines_stream(S.log_text(feed.stream), 7), shuffled_parts(rows, lambda r: r[1]), ("z", 999, "x", at(10_000_000)))
    assert {k: v for k, v in twin.items()} == {k: [list(v) for kk, v in out if kk == k and v[-1] == twin[k][-1]][0] for k in twin}
    assert all(len(v) <= 7 for _, v in out)
    line = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), "warn", "hot")], "at timestamp, level string, message string").select(S.log_line("at", "level", "message")).first()[0]
    assert line == "03:04:05 [WARN] hot"


JOBS = "id string, seq long, state string, created_at timestamp"


def test_persisted_changes(spark, tmp_path):
    """Batches that are run again, changes out of order and twice: the table is that of all changes."""
    rnd = random.Random(2)
    rows = [(f"j{rnd.randrange(6)}", k, rnd.choice("abc"), at(k * 1000)) for k in range(60)]
    rows += rnd.sample(rows, 10)
    want = sorted((i, max((r[1], r[2]) for r in rows if r[0] == i), min((r[1], r[3]) for r in rows if r[0] == i)[1]) for i in {r[0] for r in rows})
    table = lambda log: sorted((r.id, (r.seq, r.state), r.created_at) for r in log.table().collect())
    log = P.ChangeLog(spark, f"{tmp_path}/log", JOBS)
    assert table(log) == []
    feed = Feed(spark, tmp_path, JOBS)
    feed.started(feed.stream, "append", log.sink())
    rnd.shuffle(rows)
    for i in range(0, 70, 10):
        feed.add(rows[i : i + 10])
    feed.stopped()
    assert table(log) == want
    part = spark.createDataFrame(rows[10:20], JOBS)
    numbers = P._folders(spark, f"{log.root}/log")
    for _ in range(2):  # the batch that holds this part, run again
        before = spark.read.parquet(f"{log.root}/log/batch={numbers[-6]}").count()
        log.sink()(part, numbers[-6])
        assert spark.read.parquet(f"{log.root}/log/batch={numbers[-6]}").count() == before
    assert table(log) == want


def test_compacted_log(spark, tmp_path):
    log = P.ChangeLog(spark, f"{tmp_path}/log", JOBS)
    assert log.compacted() is None
    log.sink()(spark.createDataFrame([("a", 5, "x", at(5)), ("a", 9, "y", at(9))], JOBS), 0)
    assert log.compacted() == log.compacted() == 0
    log.sink()(spark.createDataFrame([("a", 7, "late", at(7)), ("b", 1, "z", at(1))], JOBS), 1)
    rows = lambda: sorted(tuple(r) for r in log.table().collect())
    assert rows() == [("a", 9, "y", at(5)), ("b", 1, "z", at(1))]
    assert log.compacted() == 1 and rows() == [("a", 9, "y", at(5)), ("b", 1, "z", at(1))]
    assert [tuple(r) for r in log.table(0).collect()] == [("a", 9, "y", at(5))]


ENVELOPES = [
    {"event": "job_update", "data": {"id": "9f", "stage": "Probing"}},
    {"event": "progress", "data": {"id": "9f", "percent": 42.5, "current_time_ms": 4250, "duration_ms": 10000, "determinate": True, "fps": 96.32, "bitrate": "5120.0kbits/s", "speed": "3.85x", "stage": "Encoding"}},
    {"event": "completed", "data": {"id": "9f", "uuid": "b1"}},
    {"event": "failed", "data": {"id": "9f", "error": "Duration mismatch: source=10.000s"}},
]
BAD = [("no json", "not_json"), ('{"data":1}', "no_event"), ('{"event":"x","data":{}}', "unknown_event"), ('{"event":"failed","data":{"id":"1"}}', "error_missing"), ('{"event":"progress","data":{"id":"1","percent":"much"}}', "percent_missing"), ('{"event":"failed","data":"text"}', "id_missing"), (None, "not_json")]


def test_dispatch(spark, tmp_path):
    """Each envelope is in one output; a batch that is run again is there once."""
    schema = "value string"
    rows = [(json.dumps(e),) for e in ENVELOPES] + [(v,) for v, _ in BAD]
    feed = Feed(spark, tmp_path, schema)
    write = E.dispatched(f"{tmp_path}/out")
    feed.started(feed.stream, "append", lambda b, n: (write(b, n), write(b, n)))
    feed.add(rows[:5]).add(rows[5:])
    feed.stopped()
    read = lambda k: spark.read.parquet(f"{tmp_path}/out/{k}").drop("batch")
    assert [tuple(r) for r in read("job_update").collect()] == [("9f", "Probing", None)]
    assert [r.asDict() for r in read("progress").collect()] == [ENVELOPES[1]["data"]]
    assert [tuple(r) for r in read("completed").collect()] == [("9f", "b1")]
    assert [tuple(r) for r in read("failed").collect()] == [("9f", "Duration mismatch: source=10.000s")]
    assert sorted(((r.value, r.problem) for r in read(E.DEAD).collect()), key=repr) == sorted(BAD, key=repr)


def test_fan_out(spark):
    jobs = spark.createDataFrame([("1", "u1"), ("2", None)], "id string, uuid string")
    changes = spark.createDataFrame([("1", 1, "probing", "Probing", None), ("1", 2, "completed", "Done", None), ("2", 3, "failed", "Failed", 'bad "x"')], "id string, seq long, phase string, stage string, error string")
    got = [(r.seq, json.loads(r.value)) for r in E.fanned_out(jobs, changes).orderBy("seq", "place").collect()]
    assert got == [
        (1, {"event": "job_update", "data": {"id": "1", "stage": "Probing", "phase": "probing"}}),
        (2, {"event": "job_update", "data": {"id": "1", "stage": "Done", "phase": "completed"}}),
        (2, {"event": "completed", "data": {"id": "1", "uuid": "u1"}}),
        (3, {"event": "job_update", "data": {"id": "2", "stage": "Failed", "phase": "failed"}}),
        (3, {"event": "failed", "data": {"id": "2", "error": 'bad "x"'}}),
    ]
    text = spark.createDataFrame([("a", 'no "json"'), ("b", None)], "e string, d string").select(E.envelope(F.col("e"), F.col("d")).alias("v")).collect()
    assert json.loads(text[0].v) == {"event": "a", "data": 'no "json"'}


def test_progress_joined_with_jobs(spark, tmp_path):
    schema = "id string, seq long, percent double, stage string, fps double, bitrate string, speed string, current_time_ms long"
    rows = [(f"j{k % 4}", k, k / 2, "Encoding", 25.0, "1k", "1x", k * 40) for k in range(40)]
    jobs = spark.createDataFrame([("j0",), ("j1",), ("j9",)], "id string")
    twin = sorted(map(tuple, D.with_progress(jobs, spark.createDataFrame(rows, schema)).collect()))
    feed = Feed(spark, tmp_path, schema)
    feed.started(E.progress_stream(feed.stream, jobs), "complete")
    for p in shuffled_parts(rows, lambda r: r[1]):
        feed.add(p)
    fields = ("percent", "stage", "fps", "bitrate", "speed", "current_time_ms")
    got = jobs.join(spark.table(feed.name), "id", "left").select("id", *(F.col(f"progress.{c}") for c in fields))
    assert sorted(map(tuple, got.collect())) == twin
    assert {r[0] for r in feed.rows()} == {"j0", "j1"}
    feed.stopped()


def test_store_is_required(spark):
    key, value = fold.STORE
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="stateStore"):
            fold.require_store(spark)
    finally:
        spark.conf.set(key, value)
