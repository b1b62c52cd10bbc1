"""Encodes: the registry of output profiles, the arguments of each job's encode, and which policy of a configuration holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R

# The five output profiles.
PROFILE_DDL = """name string, container string, video_codec string, pix_fmt string, width int, height int, fps_num int, fps_den int, interlaced boolean, field_order string, gop_size_secs double, closed_gop boolean,
 colorspace string, color_trc string, color_primaries string, video_profile string, video_level string, crf int, maxrate string, bufsize string, faststart boolean"""
PROFILES = [
    ("h264-1080p25", "mp4", "libx264", "yuv420p", 1920, 1080, 25, 1, False, "progressive", 2.0, True, "bt709", "bt709", "bt709", "high", "4.2", 17, "15M", "30M", True),
    ("h264-1080i50", "mp4", "libx264", "yuv420p", 1920, 1080, 25, 1, True, "tff", 2.0, True, "bt709", "bt709", "bt709", "high", "4.2", 18, "15M", "30M", True),
    ("h264-720p50", "mp4", "libx264", "yuv420p", 1280, 720, 50, 1, False, "progressive", 2.0, True, "bt709", "bt709", "bt709", "high", "4.1", 17, "12M", "24M", True),
    ("prores-1080i50", "mov", "prores_ks", "yuv422p10le", 1920, 1080, 25, 1, True, "tff", 0.0, True, "bt709", "bt709", "bt709", "3", None, None, None, None, True),
    ("h264-1080p25-sd-pal", "mp4", "libx264", "yuv420p", 1920, 1080, 25, 1, False, "progressive", 2.0, True, "smpte170m", "smpte170m", "smpte170m", "high", "4.2", 20, "10M", "20M", True),
]
# The profile of each encoder.
OF_ENCODER = {"a": "h264-1080p25", "b": "h264-1080i50", "c": "h264-1080p25-sd-pal"}
# Colour constants that an encoder takes.
COLORSPACES = ["undef", "bt709", "smpte170m", "smpte240m"]
COLOR_TRCS = ["undef", "bt709", "smpte170m", "smpte240m", "bt470bg", "linear", "smpte2084", "bt2020-10", "bt2020-12", "iec61966-2-1", "arib-std-b67"]
COLOR_PRIMARIES = ["undef", "bt709", "smpte170m", "smpte240m", "bt470bg", "film", "bt2020", "smpte431", "smpte432", "jedec-p22"]


def profiles(spark: SparkSession, prefix: str = "") -> DataFrame:
    """The registry; prefix stands before each name."""
    return spark.createDataFrame([(prefix + row[0], *row[1:]) for row in PROFILES], PROFILE_DDL)


def profile_name(asked: Column, prefix: str = "") -> Column:
    """The name of the profile asked for, A-Z without case: by its name, or as encoder a, profilea or profile_a (and so on);
    null for any other."""
    low = R.ascii_lower(asked)
    named = [(low == (prefix + row[0]).lower(), prefix + row[0]) for row in PROFILES]
    return R.first_of(named + [(low.isin(k, f"profile{k}", f"profile_{k}"), prefix + name) for k, name in OF_ENCODER.items()])


def color_problem(encoder: Column) -> Column:
    """The first colour constant of a struct (colorspace, color_trc, color_primaries) that no encoder takes."""
    return R.first_of([
        (~encoder["colorspace"].isin(COLORSPACES), "colorspace"),
        (~encoder["color_trc"].isin(COLOR_TRCS), "color_trc"),
        (~encoder["color_primaries"].isin(COLOR_PRIMARIES), "color_primaries"),
    ])


def audio_filter(channels: Column, preserve: Column, targets: list[Column], measured: Column) -> Column:
    """The filter of a job's sound; '' for none. measured: a struct (is_silent, is_linear, target_i, target_tp, target_lra,
    input_i, input_tp, input_lra, input_thresh, target_offset), or null."""
    down = R.downmix(channels, preserve)
    two = lambda c: F.format_string("%.2f", c)
    text = lambda pairs: F.concat(F.lit("loudnorm="), F.concat_ws(":", *(F.concat(F.lit(f"{k}="), v) for k, v in pairs), F.lit("print_format=summary")))
    names = {"I": "target_i", "TP": "target_tp", "LRA": "target_lra", "measured_I": "input_i", "measured_TP": "input_tp", "measured_LRA": "input_lra", "measured_thresh": "input_thresh", "offset": "target_offset"}
    second = text([*((k, two(measured[f])) for k, f in names.items()), ("linear", measured["is_linear"].cast("string"))])
    first = text([(k, two(v)) for k, v in zip(("I", "TP", "LRA"), targets)])
    return F.when(measured.isNull(), F.concat(down, first)).when(measured["is_silent"], F.regexp_replace(down, ",+$", "")).otherwise(F.concat(down, second))


def encode_arguments(jobs: DataFrame) -> DataFrame:
    """id, problem and args, the arguments of each job's encode; where there is a problem, args is null. jobs: id,
    input_path, output_path, encoder (struct of ENCODERS), settings (struct analyzeduration, probesize, preset, tune, crf,
    maxrate, bufsize, threads), audio (struct mode, codec, bitrate, preserve, target_i, target_tp, target_lra), channels,
    measured (as of audio_filter)."""
    e, s, a = F.col("encoder"), F.col("settings"), F.col("audio")
    fps_num, fps_den = F.lit(25), F.lit(1)
    gop = R.gop(fps_num, fps_den).cast("string")
    words = lambda *xs: F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    size = F.concat(e["target_width"].cast("string"), F.lit(":"), e["target_height"].cast("string"))
    picture = F.concat(F.lit("fps=25/1,scale="), size, F.lit(":force_original_aspect_ratio=decrease,pad="), size, F.lit(":(ow-iw)/2:(oh-ih)/2,setsar=1,format=yuv420p"))
    gops = F.concat(F.lit("open-gop=0:keyint="), gop, F.lit(":min-keyint="), gop, F.lit(":scenecut=0"))
    none = F.array().cast("array<string>")
    legacy = a["mode"] == "legacy_v1_encode"
    problem = F.when(~legacy & (F.col("channels") > 0) & (R.downmix(F.col("channels"), a["preserve"]) == "unsupported_audio_channel_layout"), "unsupported_audio_channel_layout")
    targets = R.loudness_targets(a["mode"], a["target_i"], a["target_tp"], a["target_lra"])
    sound = audio_filter(F.col("channels"), a["preserve"], targets, F.col("measured"))
    filtered = F.when(~legacy & (F.col("channels") > 0) & (sound != ""), words("-af", sound)).otherwise(none)
    out = F.when(~legacy & a["preserve"] & (F.col("channels") > 2), F.col("channels").cast("string")).otherwise("2")
    rate = words("-ar", "48000", "-ac", out)
    coded = F.when(a["codec"] == "pcm_s16le", rate).when(a["codec"] == "libmp3lame", F.concat(words("-b:a", a["bitrate"]), rate)).otherwise(F.concat(words("-b:a", a["bitrate"]), rate, words("-async", "1")))
    args = F.concat(
        words("-y", "-hide_banner", "-loglevel", "info", "-stats", "-analyzeduration", s["analyzeduration"], "-probesize", s["probesize"], "-fflags", "+genpts", "-i", F.col("input_path"), "-map_metadata", "-1", "-map_chapters", "-1"),
        words("-vf", picture, "-fps_mode", "cfr", "-video_track_timescale", "1000", "-f", "mp4", "-c:v", "libx264", "-preset", s["preset"], "-crf", s["crf"].cast("string"), "-maxrate", s["maxrate"], "-bufsize", s["bufsize"]),
        words("-profile:v", e["profile_h264"], "-level", e["level_h264"], "-pix_fmt", "yuv420p", "-r", "25/1", "-colorspace", e["colorspace"], "-color_trc", e["color_trc"], "-color_primaries", e["color_primaries"]),
        words("-g", gop, "-keyint_min", gop, "-sc_threshold", "0", "-x264-params", F.when(e["interlaced"], F.concat(gops, F.lit(":interlaced=1:pic-struct=1"))).otherwise(gops)),
        F.when(e["interlaced"], words("-flags", "+ilme+ildct", "-field_order", "tt")).otherwise(none),
        F.when((s["tune"] != "") & (s["tune"] != "none"), words("-tune", s["tune"])).otherwise(none),
        words("-movflags", "+faststart", "-threads", s["threads"].cast("string"), "-map", "0:v:0", "-map", "0:a:0?"),
        filtered,
        words("-c:a", a["codec"]),
        coded,
        words("-max_muxing_queue_size", "4096", F.col("output_path")),
    )
    return jobs.select("id", problem.alias("problem"), F.when(problem.isNull(), args).alias("args"))


AUDIO = "struct<mode: string, codec: string, bitrate: string, sample_rate_hz: bigint, channels: bigint, channel_layout: string, target_lufs: double, true_peak_dbtp: double, lra_target: double, dual_mono: boolean, preserve_original: boolean>"
VALIDATION = "struct<enforce_closed_gop: boolean, enforce_faststart: boolean, enforce_48k_audio: boolean, max_duration_delta_ms: bigint, strict_ready_blocking: boolean>"
STORAGE = "struct<atomic_publication: boolean, preserve_subclips_on_purge: boolean, clean_source_after_success: boolean>"
RETRY = "struct<max_attempts: bigint, retry_delay_ms: bigint, auto_retry_on_start: boolean>"
TOOLS = "struct<encoder_path: string, probe_path: string, verify_on_startup: boolean>"


def effective_policies(configs: DataFrame) -> DataFrame:
    """configs with the policies that hold: each as it is given, else made from the older settings or their defaults.
    conflicts names given policies that differ from the older settings beside them. configs: encoding (audio_codec,
    audio_bitrate), ingestion (clean_source_after_success, max_attempts, retry_delay_ms, auto_retry_on_start), and
    audio_policy, validation_policy, storage_policy, retry_policy, toolchain_policy (structs or null)."""
    e, i = F.col("encoding"), F.col("ingestion")
    lit = F.lit
    audio = F.struct(lit("legacy_v1_encode"), e["audio_codec"], e["audio_bitrate"], lit(48000), lit(2), lit(None), lit(None), lit(None), lit(None), lit(False), lit(False)).cast(AUDIO)
    validation = F.struct(lit(True), lit(True), lit(True), lit(80), lit(False)).cast(VALIDATION)
    stored = F.struct(lit(False), lit(True), i["clean_source_after_success"]).cast(STORAGE)
    retry = F.struct(i["max_attempts"], i["retry_delay_ms"], i["auto_retry_on_start"]).cast(RETRY)
    tools = F.struct(lit(None), lit(None), lit(True)).cast(TOOLS)
    given = {"audio_policy": audio, "validation_policy": validation, "storage_policy": stored, "retry_policy": retry, "toolchain_policy": tools}
    differs = [
        ((F.col("audio_policy.codec") != e["audio_codec"]) | (F.col("audio_policy.bitrate") != e["audio_bitrate"]), "audio_policy"),
        (F.col("storage_policy.clean_source_after_success") != i["clean_source_after_success"], "storage_policy"),
    ]
    conflicts = F.array_compact(F.array(*(F.when(test, lit(name)) for test, name in differs)))
    return configs.withColumns({**{n: F.coalesce(n, made) for n, made in given.items()}, "conflicts": conflicts})
