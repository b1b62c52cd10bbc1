"""Golden cases of the rule library, the transitions and the stateful steps."""

import pytest
from pyspark.sql import functions as F

from castlake.functions import rules as R
from castlake.operators import assets as A
from castlake.operators import jobs as J
from castlake.operators import transitions as T
from castlake.sources import media


def value(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()
    return tuple(row) if len(columns) > 1 else row[0]


@pytest.mark.parametrize("num,den,want", [(29970, 1000, (30000, 1001)), (23976, 1000, (24000, 1001)), (48, 1, (48, 1)), (24, 1, (24000, 1001)), (30, 1, (30000, 1001)), (60, 1, (60, 1)), (25, 0, (25, 1))])
def test_snapped(spark, num, den, want):
    assert value(spark, *R.snapped(F.lit(num), F.lit(den))) == want


@pytest.mark.parametrize("text,want", [("30000/1001", (30000, 1001)), ("x/y", (25, 1)), ("29.97", (29970, 1000)), ("what", (25000, 1000))])
def test_parsed_rate(spark, text, want):
    assert value(spark, *R.parsed_rate(F.lit(text))) == want


@pytest.mark.parametrize("frames,ok", [([0, 2000, 4000, 6000], True), ([0, 1000, 2000, 4000], False), ([0], True), ([], True)])
def test_closed_gop(spark, frames, ok):
    assert value(spark, R.closed_gop(F.array(*map(F.lit, frames)).cast("array<long>"), F.lit(25), F.lit(1))) is ok


@pytest.mark.parametrize("message,validation,want", [("os error 32 / file locked", False, "Retryable"), ("Probe: bad", False, "Permanent"), ("Job cancelled by user", False, "Cancelled"), ("anything", True, "Permanent"), ("blocked", False, "Retryable"), ("odd", False, "Retryable")])
def test_error_class(spark, message, validation, want):
    assert value(spark, R.error_class(F.lit(message), F.lit(validation))) == want


@pytest.mark.parametrize("name,temp", [("/a/.x.mp4", True), ("/a/~x.mp4", True), ("/a/x.json", True), ("/a/x.mp4.crdownload", True), ("/a/x.TMP", True), ("/a/x.mp4", False), ("/a/noext", False)])
def test_temp_names(spark, name, temp):
    assert value(spark, R.is_temp_name(F.lit(name))) is temp


@pytest.mark.parametrize("rating,ok", [("K", True), ("k++", True), ("18+", True), ("", True), ("none", True), ("13", False)])
def test_ratings(spark, rating, ok):
    assert value(spark, R.valid_rating(F.lit(rating))) is ok


@pytest.mark.parametrize("folder,ok", [("/", True), ("/a/b", True), ("a", False), ("/a/", False), ("/a/../b", False), ("", False)])
def test_folders(spark, folder, ok):
    assert value(spark, R.valid_folder(F.lit(folder))) is ok


def test_fingerprint(spark):
    import hashlib

    for raw in (b"abc", bytes(range(256)) * 1000):
        n = len(raw)
        body = raw if n <= 196608 else raw[:65536] + raw[n // 2 - 32768 : n // 2 + 32768] + raw[-65536:]
        want = int.from_bytes(hashlib.sha256(n.to_bytes(8, "little") + body).digest()[:8], "big", signed=True)
        assert spark.createDataFrame([(bytearray(raw),)], "c binary").select(R.fingerprint(F.col("c"))).first()[0] == want


def test_request_hash(spark):
    for fp, frames in ((1234567890123, 250), (-5, 1 << 60)):
        mask = (1 << 64) - 1
        want = (fp & mask) ^ (((frames << 13) | (frames >> 51)) & mask)
        assert value(spark, R.request_hash(F.lit(fp).cast("long"), F.lit(frames).cast("long"))) == f"{want:016x}"


def test_frame_trim(spark):
    t = R.frame_trim(F.lit(5000), F.lit(15000), F.lit(20000), F.lit(25), F.lit(1))
    assert value(spark, *t.values()) == (125, 375, 250)
    assert value(spark, *R.frame_trim(F.lit(0), F.lit(0), F.lit(0), F.lit(25), F.lit(1)).values()) == (None, None, None)


def test_loudness(spark):
    assert value(spark, *R.loudness_targets(F.lit("atsc_a85"), F.lit(None).cast("double"), F.lit(-1.5), F.lit(None).cast("double"))) == (-24.0, -1.5, 11.0)
    assert value(spark, R.is_silent(F.lit(float("-inf")))) and not value(spark, R.is_silent(F.lit(-23.0)))


def test_json_strings(spark):
    texts = ['["a","b"]', '["a",1]', "[]", "x", "[null]"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.json_strings(F.col("t"))).collect()]
    assert got == [["a", "b"], [], [], [], []]


ROW = "uuid string, fingerprint long, current_path string, virtual_folder string, original_virtual_folder string, deleted_at timestamp_ntz, status string, display_name string, duration_ms long, trim_in_ms long, trim_out_ms long, mezzanine_ok boolean"


def asset(uuid, folder, deleted=None, path="/p", **more):
    row = dict(uuid=uuid, fingerprint=1, current_path=path, virtual_folder=folder, original_virtual_folder=folder if deleted else None, deleted_at=deleted, status="ready", display_name=uuid, duration_ms=1000, trim_in_ms=0, trim_out_ms=1000, mezzanine_ok=True)
    return tuple((row | more).values())


def test_prefix_isolation_and_fallback(spark):
    a = spark.createDataFrame([asset("1", "/Shows/Drama"), asset("2", "/Shows/Drama/Season1"), asset("3", "/Shows/Dramatic")], ROW)
    gone = T.trashed_folder(a, "/Shows/Drama", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    assert {r.uuid for r in A.trashed(gone).collect()} == {"1", "2"}
    back = T.restored_folder(gone, "/Shows/Drama", to_root=True)
    assert {r.uuid: r.virtual_folder for r in back.collect()} == {"1": "/", "2": "/", "3": "/Shows/Dramatic"}


def test_retention_and_references(spark):
    import datetime as d

    a = spark.createDataFrame([asset("old", "/a", d.datetime(2024, 1, 1)), asset("new", "/a", d.datetime(2024, 1, 14), path="/q"), asset("live", "/a")], ROW)
    which = F.coalesce(T.expired(14, F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")), F.lit(False))
    assert [(r.uuid, r.file_removed) for r in T.purge_report(a, which).collect()] == [("old", False)]
    assert T.purged(a, F.lit(False)).count() == 3


def test_overview_and_page(spark):
    import datetime as d

    a = spark.createDataFrame([asset("m", "/a"), asset("s", "/a", trim_in_ms=10), asset("t", "/a", d.datetime(2024, 1, 1))], ROW)
    o = A.overview(a).first()
    assert (o.total, o.master, o.subclips, o.trashed, o.ready) == (2, 1, 1, 1, 2)
    assert {r.total for r in A.viewer(a, "all").collect()} == {3}
    assert [(r.uuid, r.total) for r in A.viewer(a, "ALL", offset=50).collect()] == [(None, 3)]  # the total stays behind the end


def test_recovery(spark):
    import datetime as d

    at = d.datetime(2024, 1, 1)
    row = lambda i, attempt: (i, "Processing", "encoding", attempt, 2, "encoding", None, None, "w1", at, at, None)
    j = spark.createDataFrame([row("a", 1), row("b", 2)], "id string, state string, phase string, attempt long, max_attempts long, current_stage string, error string, error_category string, worker_id string, leased_until timestamp_ntz, heartbeat_at timestamp_ntz, finished_at timestamp_ntz")
    out = {r.id: r for r in J.recovered(j, F.lit(at).cast("timestamp_ntz")).collect()}
    assert {(i, r.state, r.attempt, r.worker_id, r.error_category) for i, r in out.items()} == {("a", "Pending", 2, None, None), ("b", "Failed", 2, None, "lease_expired")}
    assert out["a"].finished_at is None and out["b"].finished_at == at and out["b"].error.startswith("Worker crashed")


def test_probe(spark):
    doc = '{"streams":[{"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":2},{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"r_frame_rate":"25/1","nb_frames":"250","field_order":"tt"}],"format":{"duration":"11.0"}}'
    p = media.probed(spark.createDataFrame([(doc,), ("{}",)], "document string")).select("probe.*").collect()
    assert (p[0].duration_secs, p[0].frame_count, p[0].audio_sample_rate, p[0].field_order) == (10.0, 250, 48000, "tt")
    assert (p[1].duration_secs, p[1].video_codec) == (0.0, "none")


def test_listing(spark, tmp_path):
    for name in ("a.mp4", ".b.mp4", "c.mov.part", "d.txt"):
        (tmp_path / name).write_bytes(b"x" * 5)
    assert [(r.path.split("/")[-1], r.size) for r in media.listing(spark, str(tmp_path)).collect()] == [("a.mp4", 5)]
