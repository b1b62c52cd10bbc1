"""Sources and sinks: file listings, probe documents, keyframe and log text, sidecars, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R

STREAM = "struct<codec_type:string,codec_name:string,width:bigint,height:bigint,r_frame_rate:string,avg_frame_rate:string,duration:string,time_base:string,duration_ts:string,nb_frames:string,field_order:string,sample_rate:string,channels:bigint>"
PROBE = f"struct<streams:array<{STREAM}>,format:struct<duration:string>>"
LOUDNESS = "struct<input_i:string,input_tp:string,input_lra:string,input_thresh:string,target_offset:string>"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime of media files below root that are not in flight; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = files.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
    return out.where(~R.is_temp_name(F.col("path")) & R.extension_allowed(F.col("path")))


def watched(spark: SparkSession, root: str, files_per_trigger: int = 256) -> DataFrame:
    """New files below root as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(root).select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))


def _positive(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n)


def probed(df: DataFrame, document: str = "document") -> DataFrame:
    """df with struct probe from a probe document: first video and first audio stream, duration by cascade, snapped rate."""
    d = F.from_json(F.col(document), PROBE)
    first = lambda kind: F.get(F.filter(d["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    df = df.withColumns({"_video": first("video"), "_audio": first("audio"), "_format": d["format"]["duration"]})
    num, den = R.parsed_rate(F.coalesce(F.col("_video.r_frame_rate"), F.col("_video.avg_frame_rate"), F.lit("25/1")))
    num, den = R.snapped(num, den)
    base = F.split(F.col("_video.time_base"), "/")
    ticks = _positive(F.col("_video.duration_ts")) * _positive(F.get(base, F.lit(0))) / _positive(F.get(base, F.lit(1)))
    frames = _positive(F.col("_video.nb_frames")) / R.rate(num, den)
    secs = F.coalesce(_positive(F.col("_video.duration")), ticks, frames, _positive(F.col("_format")), _positive(F.col("_audio.duration")), F.lit(0.0))
    probe = F.struct(
        secs.alias("duration_secs"),
        F.round(secs * R.rate(num, den)).cast("long").alias("frame_count"),
        F.coalesce(F.col("_video.width"), F.lit(0)).alias("width"),
        F.coalesce(F.col("_video.height"), F.lit(0)).alias("height"),
        F.coalesce(F.col("_video.codec_name"), F.lit("none")).alias("video_codec"),
        F.coalesce(F.col("_audio.codec_name"), F.lit("none")).alias("audio_codec"),
        F.coalesce(F.col("_audio.sample_rate").try_cast("long"), F.lit(0)).alias("audio_sample_rate"),
        F.coalesce(F.col("_audio.channels"), F.lit(0)).alias("audio_channels"),
        num.alias("fps_num"),
        den.alias("fps_den"),
        F.coalesce(F.col("_video.field_order"), F.lit("unknown")).alias("field_order"),
    )
    return df.withColumn("probe", probe).drop("_video", "_audio", "_format")


def keyframes_ms(text: Column) -> Column:
    """Milliseconds from lines of seconds; lines that are no number are left out."""
    seconds = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, ",", " ")).try_cast("double"))
    return F.transform(F.filter(seconds, lambda s: s.isNotNull()), lambda s: F.round(s * 1000).cast("long"))


def first_keyframe_ms(text: Column) -> Column:
    """Milliseconds of the first line that is a number of seconds; 0 if there is none."""
    seconds = F.transform(F.split(text, "\n"), lambda x: R.stripped(x).try_cast("double"))
    return F.coalesce(F.round(F.get(F.filter(seconds, lambda s: s.isNotNull()), F.lit(0)) * 1000).cast("long"), F.lit(0).cast("long"))


def loudness_document(text: Column) -> Column:
    """The document between the first { and the last } of a log."""
    return F.from_json(F.regexp_extract(text, "(?s)\\{.*\\}", 0), LOUDNESS)


def measured_loudness(text: Column, secs: Column, targets: list[Column]) -> Column:
    """Struct of a loudness log: its figures as numbers, the targets (i, tp, lra), and whether the sound is silent, short,
    or can be brought to the target by gain alone; null where a figure is missing or no number. Without an offset it is the way
    from the measured loudness to the target (0 for silence)."""
    # transform computes its array once; written out, each use of a figure would parse the document anew
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))

    def of_document(d: Column) -> Column:
        texts = F.array(*(d[n] for n in ("input_i", "input_tp", "input_lra", "input_thresh", "target_offset")))
        numbers = F.transform(texts, lambda t: R.stripped(t).try_cast("double"))
        return once(F.transform(numbers, lambda x: F.when(~F.isnan(x), x)), lambda x: of_figures(d, *(F.get(x, F.lit(k)) for k in range(5))))

    def of_figures(d: Column, i: Column, tp: Column, lra: Column, thresh: Column, written: Column) -> Column:
        given = F.when(F.abs(i) < float("inf"), targets[0] - i).otherwise(F.lit(0.0))
        offset = F.when(d["target_offset"].isNotNull(), written).otherwise(given)
        flags = {"is_silent": R.is_silent(i), "is_short": R.is_short(secs), "is_linear": R.is_linear(i, tp, lra, secs, *targets)}
        figures = {"input_i": i, "input_tp": tp, "input_lra": lra, "input_thresh": thresh, "target_offset": offset, **dict(zip(("target_i", "target_tp", "target_lra"), targets)), **flags}
        whole = i.isNotNull() & tp.isNotNull() & lra.isNotNull() & thresh.isNotNull() & offset.isNotNull()
        return F.when(whole, F.struct(*(v.alias(n) for n, v in figures.items())))

    return once(loudness_document(text), of_document)


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).select(F.explode("fixtures").alias("f")).select("f.*")


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new version beside the old ones; never over one that is being read."""
    path = f"{root}/v{version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def schema_rows(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, bool]]:
    return [(name, f.name, f.dataType.simpleString(), f.nullable) for name, df in tables.items() for f in df.schema]
