"""Cleanup, settling, requests, details and labels on odd rows: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from castlake.functions import rules as R
from castlake.operators import assets as A
from castlake.operators import details as D
from castlake.operators import encodes as C
from castlake.operators import jobs as J
from castlake.operators import transitions as T
from castlake.sources import media

SOURCE = "job_id string, path string, is_dir boolean, is_there boolean, final_path string, initial_size long, initial_mtime long, size long, mtime long"
JOB = "id string, input_path string, state string"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_cleanup_reasons(spark):
    rows = [
        ("1", "/w/a", False, True, None, 5, 1, 5, 1),
        ("2", "/w/a", False, True, None, 5, 1, 5, 1),
        (None, "/w/b", False, True, "/w/b", None, None, 5, 1),
        (None, "/w/c", False, True, "/o/c", None, None, 5, 1),
        ("4", "/w/d", False, True, None, 5, None, 6, 1),
        ("5", "/w", False, True, None, None, None, 5, 1),
        ("6", "/wx/a", False, True, None, None, None, 5, 1),
        ("7", "/w/../w/a", False, True, None, None, None, 5, 1),
    ]
    jobs = spark.createDataFrame([("1", "/w/a", "Processing"), ("9", "/w/c", "Pending"), ("8", "/w/d", "Failed")], JOB)
    sources = spark.createDataFrame(rows, SOURCE)
    got = sorted((r.job_id or "", r.path, r.reason, r.deleted, r.skipped) for r in D.cleanup_decisions(sources, jobs, "/w", "/o").collect())
    assert [x[2] for x in got] == ["source_matches_target", "source_referenced", "deleted", "source_referenced", "source_changed", "source_is_directory", "outside_source_root", "unsafe_path"]
    assert all(d != s for *_, d, s in got)
    assert {r.reason for r in D.cleanup_decisions(sources, jobs, "/w", "/o", enabled=False).collect()} == {"disabled"}
    assert D.cleanup_decisions(sources.limit(0), jobs.limit(0), "/w", "/o").count() == 0


def test_flush_settles_before_time_runs_out(spark):
    polls = {
        "three": [(0, 5), (1, 5), (2, 5)],
        "two": [(0, 5), (1, 5)],
        "grows": [(0, 5), (1, 6), (2, 6), (3, 7), (4, 7)],
        "empty": [(0, 0), (1, 0), (2, 0), (3, None)],
        "gap": [(0, 5), (1, 5), (2, None), (3, 5), (4, 5)],
        "late": [(0, 5), (11, 6), (12, 6), (13, 6)],
        "just": [(0, 5), (1, 5), (11, 5)],
    }
    df = spark.createDataFrame([(p, a, s) for p, xs in polls.items() for a, s in xs], "path string, at long, size long")
    assert {r.path for r in D.flushed(df, 10).where("settled").collect()} == {"three", "just"}
    assert D.flushed(df, 10).count() == len(polls)
    assert D.flushed(df.limit(0), 10).count() == 0


def test_orphans_are_old_files_of_the_folder_itself(spark):
    df = spark.createDataFrame([("/o/.tmp_a", 10), ("/o/.tmp_b", 95), ("/o/x/.tmp_c", 10), ("/o/d.mp4", 10), ("/o/e.tmp_json", 200)], "path string, mtime long")
    assert [r.path for r in D.orphans(df, "/o", F.lit(100), 60).collect()] == ["/o/.tmp_a"]


def test_subclips_without_keyframes_or_parent(spark):
    assets = spark.createDataFrame([("a", 1000, True, None, 25, 1, None), ("b", 0, True, [0], 25, 1, None), ("c", 1000, False, [0], 0, 0, None), ("d", 1000, True, [], 25, 1, None)], "uuid string, duration_ms long, mezzanine_ok boolean, keyframes array<long>, fps_num long, fps_den long, deleted_at string")
    requests = spark.createDataFrame([(u, "n", 500, 0) for u in ("a", "b", "c", "d", "e", None)], "parent string, name string, trim_in long, trim_out long")
    got = {r.parent: (r.problem, r.effective_out, r.warnings) for r in D.subclip_checks(requests, assets).collect()}
    assert got == {"a": (None, 1000, []), "b": ("no_duration", None, []), "c": (None, 1000, []), "d": (None, 1000, ["trim_in_not_keyframe_aligned"]), "e": ("parent_not_found", None, []), None: ("parent_not_found", None, [])}


def test_retries_end_at_the_first_run_that_settles(spark):
    runs = [("a", 1, "busy"), ("a", 2, None), ("a", 3, "busy"), ("b", 1, "busy"), ("c", 1, "probe: x"), ("c", 2, None), ("d", 1, "busy"), ("d", 2, "busy"), ("d", 3, "busy"), ("e", 1, "stop")]
    got = {r.id: (r.phase, r.state, r.attempts) for r in D.attempts(spark.createDataFrame(runs, "id string, attempt long, error string"), 3).collect()}
    assert got == {"a": ("completed", "Completed", 2), "b": ("recoverable", "Processing", 1), "c": ("failed", "Failed", 1), "d": ("failed", "Failed", 3), "e": ("cancelled", "Cancelled", 1)}


def test_labels(spark):
    assert one(spark, *(D.duration_label(F.lit(x)) for x in (None, 0, -5, 900, 59900, 60000, 3725000))) == ("—", "—", "—", "0.9s", "59.9s", "1:00", "62:05")
    eta = lambda *x: D.eta_label(*map(F.lit, x))
    assert one(spark, eta(50.0, "2x", 10000, 4000), eta(50.0, "", 10000, 4000), eta(0.0, "2x", 10000, 4000), eta(50.0, "N/A", 10000, 4000), eta(50.0, "0x", 10000, 4000), eta(50.0, "1x", 100000, 4000), eta(50.0, None, 10000, 0)) == ("3s left", "6s left", "", "", "", "1:36 left", "")
    assert one(spark, *(D.short_error(F.lit(x)) for x in (None, "", " a \nb", "x" * 221))) == ("Unknown error", "Unknown error", "a", "x" * 217 + "…")
    assert one(spark, *(C.profile_name(F.lit(x)) for x in ("A", "Profile_B", "profilec", "profile__a", "", None))) == ("h264-1080p25", "h264-1080i50", "h264-1080p25-sd-pal", None, None, None)
    assert one(spark, *(D.json_longs(F.lit(x)) for x in ("[1,2]", "[]", "[1.5]", "{}", "bad", None))) == ([1, 2], [], [], [], [], [])
    assert one(spark, *D.threads(F.lit(0), F.lit(0), F.lit(1), F.lit(0)), *D.threads(F.lit(0), F.lit(3), F.lit(8), F.lit(4))) == (1, 1, 1, 4)


def test_progress_of_unknown_jobs_is_left_out(spark):
    jobs = spark.createDataFrame([("a",), ("b",)], "id string")
    events = spark.createDataFrame([("a", 1, 5.0, "s", 1.0, "k", "1x", 40), ("a", 2, 9.0, "s", 1.0, "k", "1x", 80), ("z", 1, 1.0, "s", 1.0, "k", "1x", 1)], "id string, seq long, percent double, stage string, fps double, bitrate string, speed string, current_time_ms long")
    assert sorted((r.id, r.progress_percent) for r in D.with_progress(jobs, events).collect()) == [("a", 9.0), ("b", None)]


def test_cleanup_warnings(spark):
    rows = [("5", "/w", None, True, None, None, None, 5, 1), ("6", " ", False, True, None, None, None, 5, 1), ("7", "C:\\", False, True, None, None, None, 5, 1), ("8", "/w/a", False, True, None, 4, 1, 5, 1), ("9", "/w/b", False, False, None, 4, 1, 5, 1)]
    out = D.cleanup_decisions(spark.createDataFrame(rows, SOURCE), spark.createDataFrame([], JOB), "/w/", "/o")
    got = {r.job_id: (r.reason, r.warning, r.enabled, r.attempted) for r in out.collect()}
    assert got == {
        "5": ("source_is_directory", "Refusing to delete watch folder root", True, True),
        "6": ("unsafe_path", "Source path is empty", True, True),
        "7": ("unsafe_path", "Cannot delete root directory", True, True),
        "8": ("source_changed", "Source file size changed during processing (was 4, now 5)", True, True),
        "9": ("already_removed", None, True, True),
    }


def test_purge_paths(spark):
    for path, why in {"": "empty", "\t\n": "empty", "/a/../b": "traversal", "a\\..\\b": "traversal", "/": "root", "\\": "root", "D:\\": "root", "/w/x": "watch", "/w": "watch", "/t/x": None, " /t/x ": None, "/tx": "outside", "/t/..x": None}.items():
        (got,) = one(spark, R.purge_path_error(F.lit(path), "/w", "/t/"))
        assert (got is None) == (why is None) and (why or "") in (got or ""), (path, got)
    assert one(spark, R.purge_path_error(F.lit("/w/x")))[0] is None


def test_tenths_are_those_of_the_double(spark):
    """Ties of the decimal text are none of the double, but for quarters."""
    from decimal import ROUND_HALF_UP, Decimal

    df = spark.range(0, 60_000, 25)
    for ms, text in df.select("id", D.tenths(F.col("id"))).collect():
        assert text == str(Decimal(ms / 1000).quantize(Decimal("0.1"), ROUND_HALF_UP)), ms
    assert one(spark, *(D.duration_label(F.lit(x)) for x in (350, 150, 250, 50))) == ("0.3s", "0.1s", "0.3s", "0.1s")
    assert one(spark, *(D.uptime_label(F.lit(x)) for x in (0, 59_999, 3_600_000, 90_061_000))) == ("0m 0s", "0m 59s", "1h 0m", "25h 1m")


def test_heartbeats_name_jobs(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([("a", "w1", False, at), ("b", "w1", False, at), ("c", "w1", True, at), ("d", "w2", False, at), ("e", None, False, at)], "id string, worker_id string, cancel_requested boolean, leased_until timestamp_ntz").withColumn("heartbeat_at", F.col("leased_until"))
    beats = spark.createDataFrame([("a", "w1"), ("a", "w1"), ("c", "w1"), ("d", "w1"), ("e", "w1"), ("x", "w1")], "id string, worker_id string")
    out = J.heartbeats(jobs, beats, F.lit(at + dt.timedelta(seconds=5)), 10)
    assert {r.id for r in out.where(F.col("leased_until") > F.lit(at)).collect()} == {"a"} and out.count() == 5
    assert {(r.id, r.cancel_requested) for r in J.cancel_flags(jobs, beats).collect()} == {("a", False), ("c", True), ("d", False), ("e", False), ("x", False)}


def test_changes_that_had_no_test(spark):
    assets = spark.createDataFrame([("a", "ready", "/p", "/f"), ("b", "processing", "/q", "/f")], "uuid string, status string, current_path string, virtual_folder string")
    more = T.added_processing(assets, spark.createDataFrame([("c", "/r")], "uuid string, current_path string"))
    assert {(r.uuid, r.status, r.virtual_folder) for r in more.collect()} == {("a", "ready", "/f"), ("b", "processing", "/f"), ("c", "processing", None)}
    assert {(r.uuid, r.status) for r in T.failed(assets, F.col("uuid") == "b").collect()} == {("a", "ready"), ("b", "error")}
    assert one(spark, R.percent(F.lit(50), F.lit(200), F.lit(1), F.lit(0)))[0] == 25.0


def test_near_marks(spark):
    import random

    rnd = random.Random(6)
    rows = [(rnd.randrange(3), k, rnd.randrange(2000)) for k in range(300)]
    marks = [(rnd.randrange(3), rnd.randrange(2000)) for _ in range(40)]
    df = A.near_marks(spark.createDataFrame(rows, "u int, id int, at long"), spark.createDataFrame(marks, "u int, mark long"), "u", "at", "mark", 7)
    want = {(i, any(v == u and abs(m - t) <= 7 for v, m in marks)) for u, i, t in rows}
    assert {(r.id, r.near) for r in df.collect()} == want and len({n for _, n in want}) == 2


def test_texts_of_the_probe(spark):
    assert one(spark, media.keyframes_ms(F.lit("0.0\n2.0,\nbad\n4.0406\n")))[0] == [0, 2000, 4041]
    assert one(spark, *(media.first_keyframe_ms(F.lit(x)) for x in ("\nN/A\n 1.5\r\n2", "", "none", "0.04"))) == (1500, 0, 0, 40)
    (got,) = one(spark, media.loudness_document(F.lit('[x] {\n"input_i" : "-23.1", "target_offset": "0.2"\n} end')))
    assert (got.input_i, got.target_offset, got.input_tp) == ("-23.1", "0.2", None)


def test_loudness_log_is_parsed_once(spark):
    texts = ["a {\n%s} b" % ", ".join(f'"{k}": "{v}"' for k, v in zip(("input_i", "input_tp", "input_lra", "input_thresh", "target_offset"), row)) for row in (
        ("-23.5", "-3.0", "5.0", "-40", "0.25"), ("-30", "-9", "5", "-40"), (" -inf ", "-3", "5", "-40"), ("-inf", "-3", "5", "-40", "nan"), ("NaN", "-3", "5", "-40"), ("-20", "x", "5", "-40"), ("-20", "-3", "5"), ("inf", "-3", "0", "-inf", "1"), ("-20", "-3", "11", "-40"))]
    df = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate([(t, 10.0) for t in texts] + [(texts[0], 2.0), (texts[0], 0.0), ("none", 9.0), ("{bad}", 9.0), ("", 9.0), (None, 9.0)])], "k int, text string, secs double")
    df = df.withColumn("m", media.measured_loudness(F.col("text"), F.col("secs"), [F.lit(-23.0), F.lit(-1.0), F.lit(7.0)]))
    df = df.select("k", "m.input_i", "m.input_tp", "m.target_offset", "m.is_silent", "m.is_short", "m.is_linear")
    inf, none = float("inf"), (None,) * 6
    assert [tuple(r)[1:] for r in df.orderBy("k").collect()] == [
        (-23.5, -3.0, 0.25, False, False, True), (-30.0, -9.0, 7.0, False, False, True), (-inf, -3.0, 0.0, True, False, False), none, none, none, none, (inf, -3.0, 1.0, True, False, False), (-20.0, -3.0, -3.0, False, False, False),
        (-23.5, -3.0, 0.25, False, True, False), (-23.5, -3.0, 0.25, False, False, True), none, none, none, none,
    ]
    assert df._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


def test_responses_have_every_field(spark):
    from castlake.plans import registry

    df = registry.QUERIES["f07_responses"](spark, "/root/testdata/sf0.001")
    plain = "uuid id current_path duration_ms trim_in_ms trim_out_ms rating tp status display_name virtual_folder mezzanine_ok fps fps_num fps_den total_frames gop_frames keyframe_safe_start_ms deleted_at original_virtual_folder"
    assert sorted(df.columns) == sorted([*plain.split(), "warnings", "keyframe_offsets"])
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    odd = [("a", 1, "x", '["w"]', "[1,2]"), ("b", 2, None, None, None), ("c", 3, "", "[1]", "[1,null]")]
    got = D.as_response(spark.createDataFrame(odd, "uuid string, fingerprint long, tp string, warnings string, keyframe_offsets_json string")).orderBy("uuid")
    assert [tuple(r) for r in got.collect()] == [("a", "x", "a", ["w"], [1, 2]), ("b", None, "b", [], []), ("c", "", "c", [], [])]
