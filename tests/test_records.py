"""Sidecar documents and storage figures: round trips, parts that are absent, files as the file system has them."""

import json
import os

from pyspark.sql import functions as F

from castlake.functions import rules as R
from castlake.plans import records, registry
from castlake.sources import media, sidecars, storage

SF = "/root/testdata/sf0.001"
DOCUMENT = {
    "external_id": "b1", "id": "b1", "path": "D:/out/videos/clip_b1.mp4", "duration_ms": 10000, "trim_in_ms": 0, "trim_out_ms": 10000, "fps_num": 25, "fps_den": 1, "mezzanine_ok": True,
    "filename": "clip_b1.mp4", "filepath": "D:/out/videos/clip_b1.mp4", "transcoded_at": "2026-08-12T10:05:23.000Z", "profile_used": "A",
    "original_source": {"path": "D:/in/clip.mov", "codec": "h264", "duration_secs": 10.0, "frame_count": 250, "width": 1920, "height": 1080, "fps": 25.0, "fps_num": 25, "fps_den": 1, "field_order": "progressive"},
    "output_media": {"duration_secs": 10.0, "frame_count": 250, "width": 1920, "height": 1080, "codec": "h264", "audio_codec": "aac", "audio_sample_rate": 48000, "audio_channels": 2, "fps_num": 25, "fps_den": 1},
    "fps": 25.0, "total_frames": 250, "gop_frames": 50, "keyframe_safe_start_ms": 0, "warnings": [],
}
FINDING = {"severity": "error", "code": "fps_mismatch", "message": "rate", "measured": "50"}
REPORT = {
    "mezzanine_ok": False, "duration_ms": 10000, "fps": 25.0, "fps_num": 25, "fps_den": 1, "audio_sample_rate": 48000, "audio_channels": 2, "closed_gop": True, "faststart": False, "warnings": ["w"],
    "findings": [FINDING], "qc_report": {"passed": False, "blocking_errors": 1, "warnings_count": 0, "findings": [FINDING]}, "sha256": "ab", "file_size_bytes": 1048576,
}
LOUDNESS = {"integrated_lufs": -23.0, "true_peak_dbtp": -1.5, "lra": 7.0, "threshold": -33.5, "target_lufs": -23.0, "target_true_peak_dbtp": -1.0, "normalization_mode": "ebu_r128", "linear_applied": True}


def written(spark, doc):
    """The text that documents() makes of an asset with the fields of doc."""
    row = {**doc, "uuid": doc["id"], "current_path": doc["path"]}
    types = {n: t for n, t in sidecars.FIELDS.items() if n in doc and n not in ("external_id", "id", "path", "filename", "filepath", "findings", "qc_report")}
    df = spark.createDataFrame([(row["uuid"], row["current_path"], json.dumps({n: doc[n] for n in types}))], "uuid string, current_path string, j string")
    parsed = df.select("uuid", "current_path", F.from_json("j", "struct<" + ", ".join(f"{n}: {t}" for n, t in types.items()) + ">").alias("s"))
    return sidecars.documents(parsed.select("uuid", "current_path", "s.*"))


def test_round_trip(spark):
    full = {**DOCUMENT, "findings": [FINDING], "qc_report": REPORT["qc_report"], "loudness": LOUDNESS, "sha256": "ab", "file_size_bytes": 1048576, "validation_report": REPORT}
    for doc in (DOCUMENT, full, {**DOCUMENT, "sha256": "cd"}, {**DOCUMENT, "loudness": LOUDNESS, "warnings": ["ä \"x\""]}):
        out = written(spark, doc)
        row = out.first()
        assert json.loads(row.document) == doc and list(json.loads(row.document)) == [n for n in sidecars.FIELDS if n in doc]
        back = sidecars.read_back(out).first()
        assert back.validation_report is None if "validation_report" not in doc else back.validation_report.asDict(True)["qc_report"]["blocking_errors"] == 1
        assert (back.loudness is None) == ("loudness" not in doc) and back.document_path == doc["path"]
        assert row.path == "D:/out/sidecars/clip_b1.uuid.json"


def test_texts_that_are_no_document(spark):
    df = spark.createDataFrame([("a", "no json"), ("b", None), ("c", "{}"), ("d", '{"id": "d", "fps": "x"}')], "uuid string, document string")
    got = {r.uuid: r.id for r in sidecars.read_back(df).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": "d"}
    assert sidecars.read_back(df.limit(0)).count() == 0


def test_qc_report(spark):
    f = "array<struct<severity:string,code:string>>"
    df = spark.createDataFrame([([],), ([("warning", "w"), ("info", "i")],), ([("error", "e"), ("warning", "w"), ("error", "f")],)], f"findings {f}")
    assert [tuple(r) for r in df.select(sidecars.qc_report(F.col("findings")).alias("q")).select("q.passed", "q.blocking_errors", "q.warnings_count").collect()] == [(True, 0, 0), (True, 0, 1), (False, 2, 1)]


def test_written_once(spark, tmp_path):
    out = written(spark, DOCUMENT)
    sidecars.write(out, f"{tmp_path}/s")
    assert sidecars.read_back(spark.read.parquet(f"{tmp_path}/s")).first().id == "b1"


def test_sidecar_paths(spark):
    df = spark.createDataFrame([("/o/videos/a.b.mp4",), ("/o/a.mp4",), ("/o/videos/sub/a.mp4",)], "p string")
    assert [r[0] for r in df.select(R.sidecar_path(F.col("p"))).collect()] == ["/o/sidecars/a.b.uuid.json", "/o/a.uuid.json", "/o/videos/sub/a.uuid.json"]


def test_storage_is_that_of_the_file_system(spark):
    got = {r.name: (r.n_files, r.bytes) for r in registry.QUERIES["s15_storage"](spark, SF).collect()}
    want = {n[:-8]: (1, os.path.getsize(f"{SF}/{n}")) for n in os.listdir(SF) if n.endswith(".parquet")}
    assert got == want
    o = registry.QUERIES["a01_overview_storage"](spark, SF).first()
    assert (o.storage_bytes, o.storage_files) == (sum(b for _, b in want.values()), len(want)) and o.total > 0 and o.total_jobs > 0


def test_storage_reads_no_contents(spark):
    plan = records.storage_figures(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "length" in plan


def test_folders(spark, tmp_path):
    for name, n in (("a.mp4", 3), ("x/b.mp4", 4), ("x/y/c.mp4", 5)):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"x" * n)
    got = {r.folder: (r.n_files, r.bytes) for r in storage.by_folder(storage.files(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert got == {"": (3, 12), "x": (2, 9), "x/y": (1, 5)}
    assert storage.by_table(storage.files(spark, str(tmp_path))).count() == 0


def test_snapshots_are_never_written_over(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([("a", 1)], "uuid string, n int")
    path = media.write_snapshot(df, str(tmp_path), 3)
    assert path.endswith("/v00000003") and [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", 1)]
    with pytest.raises(Exception, match="exist"):
        media.write_snapshot(df, str(tmp_path), 3)
    assert media.write_snapshot(df.limit(0), str(tmp_path), 4) != path


def test_schema_rows(spark):
    df = spark.createDataFrame([("a", 1)], "uuid string not null, n int")
    assert media.schema_rows({"t": df, "empty": df.select("n").limit(0)}) == [("t", "uuid", "string", False), ("t", "n", "int", True), ("empty", "n", "int", True)]


def test_fixture_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "fixtures": [{"name": "a", "frames": 250}, {"name": "b", "frames": None}]}, indent=1))
    assert sorted((r.name, r.frames) for r in media.fixtures(spark, f"{tmp_path}/m.json").collect()) == [("a", 250), ("b", None)]


def test_new_files_as_a_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.mp4").write_bytes(b"123")
    q = media.watched(spark, str(root), 1).writeStream.format("memory").queryName("watched").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    (root / "sub").mkdir()
    (root / "sub" / "b.mp4").write_bytes(b"12345")
    q.processAllAvailable()
    q.stop()
    assert sorted((r.path.rsplit("/", 1)[1], r.size) for r in spark.table("watched").collect()) == [("a.mp4", 3), ("b.mp4", 5)]
