"""The rule library: column expressions for paths, names, frame rates, loudness, quality findings and errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Media extensions, extensions of files in flight, ratings, phases of each state.
MEDIA_EXTENSIONS = ["mp4", "mov", "mxf", "mkv", "avi", "webm", "ts", "m2ts"]
TEMP_EXTENSIONS = ["tmp", "temp", "part", "partial", "crdownload", "download", "filepart", "upload", "incomplete", "json"]
RATINGS = ["K", "8", "12", "16", "18"]
PHASES_OF = {
    "Pending": ["queued"],
    "Processing": ["probing", "planned", "encoding", "normalizing_audio", "validating", "publishing", "cancel_requested", "recoverable"],
    "Completed": ["completed"],
    "Failed": ["failed"],
    "Cancelled": ["cancelled"],
}
# The phases that may follow each phase (besides itself).
NEXT_PHASES = {
    "queued": ["probing", "cancel_requested", "cancelled", "failed"],
    "probing": ["planned", "normalizing_audio", "failed", "cancel_requested", "cancelled"],
    "normalizing_audio": ["planned", "encoding", "failed", "cancel_requested", "cancelled"],
    "planned": ["encoding", "failed", "cancel_requested", "cancelled"],
    "encoding": ["validating", "failed", "recoverable", "cancel_requested", "cancelled"],
    "validating": ["publishing", "failed", "recoverable", "cancel_requested", "cancelled"],
    "publishing": ["completed", "failed"],
    "recoverable": ["encoding", "probing", "failed", "cancel_requested", "cancelled"],
    "cancel_requested": ["cancelled", "failed"],
    "failed": ["queued"],
    "completed": [],
    "cancelled": [],
}
# Message parts of each error class, in the order in which they are tried.
ERROR_PARTS = [
    ("Cancelled", ["cancelled", "canceled", "stop"]),
    ("Retryable", ["os error 32", "file locked", "sharing violation", "lock", "busy"]),
    ("Permanent", ["probe:", "profile disabled", "invalid input", "no such file or directory", "unsupported codec", "permission denied", "access is denied", "disk full", "space", "already exists", "audio measurement failed", "unsupported_audio_channel_layout", "unsupported channel layout"]),
]
# Rates that a frame rate snaps to (rate, numerator, denominator), in the order in which they are tried.
BROADCAST_RATES = [(29.97, 30000, 1001), (23.976, 24000, 1001), (59.94, 60000, 1001), (25.0, 25, 1), (50.0, 50, 1), (30.0, 30, 1), (60.0, 60, 1), (24.0, 24, 1)]
# Beginnings of log lines that say nothing.
BORING_LINES = ["Conversion failed!", "At least one output file must be specified", "frame=", "Press [q] to stop", "[libx264 @", "[mp4 @", "[aac @", "[libmp3lame @"]
# Integrated loudness, true peak and range of each mode.
LOUDNESS = {"ebu_r128": (-23.0, -1.0, 7.0), "atsc_a85": (-24.0, -2.0, 11.0)}
MONO_PAN = "pan=stereo|c0=c0|c1=c0,"
SURROUND_PAN = "pan=stereo|FL=0.4142*c0+0.2929*c2+0.2929*c4|FR=0.4142*c1+0.2929*c2+0.2929*c5,"


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def first_of(cases: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first test that holds; default where none does."""
    out = F
    for test, value in cases:
        out = out.when(test, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "[\\\\/]"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension; null for a name without one, or with a dot in front only."""
    return F.nullif(ascii_lower(F.regexp_extract(basename(path), "^.+\\.([^.]*)$", 1)), F.lit(""))


def stem(path: Column, most: int = 255) -> Column:
    return F.left(F.regexp_replace(basename(path), "(?<=.)\\.[^.]*$", ""), F.lit(most))


def is_temp_name(path: Column) -> Column:
    name = basename(path)
    return name.startswith(".") | name.startswith("~") | name.endswith(".json") | F.coalesce(extension(path).isin(TEMP_EXTENSIONS), F.lit(False))


def extension_allowed(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    ext = extension(path)
    test = ext.isin(MEDIA_EXTENSIONS)
    if include:
        test &= ext.isin(list(include))
    if exclude:
        test &= ~ext.isin(list(exclude))
    return F.coalesce(test, F.lit(False))


def in_folder(folder: Column, root: str) -> Column:
    """Whether folder is root or below it; the root / holds all. Below: compared without the case of A-Z."""
    root = root.rstrip("/")
    if not root:
        return F.lit(True)
    return (folder == root) | ascii_lower(folder).startswith(root.translate(str.maketrans(UPPER, LOWER)) + "/")


def valid_rating(rating: Column) -> Column:
    plain = F.upper(F.regexp_replace(rating, "\\++$", ""))
    return plain.isin([*RATINGS, "NONE", ""])


def valid_folder(folder: Column) -> Column:
    return folder.startswith("/") & ~folder.contains("..") & ((folder == "/") | ~folder.endswith("/"))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def below(path: Column, root: str) -> Column:
    """Whether path is root, or lies below it; whole components count."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def purge_path_error(path: Column, watch: str | None = None, target: str | None = None) -> Column:
    """Why a file must not be purged; null where it may. Components are parted by either slash; the folders, where they
    are given, are such as links are resolved in."""
    p = stripped(path)
    # The messages.
    cases = [
        (p == "", "Path is empty"),
        (F.array_contains(F.split(p, r"[/\\]"), ".."), "Path contains parent directory traversal (..)"),
        ((p == "/") | (p == "\\") | ((F.length(p) <= 3) & p.endswith(":\\")), "Cannot purge root directory"),
    ]
    if watch is not None:
        cases.append((below(p, watch), "Refusing to purge source media in watch folder"))
    if target is not None:
        cases.append((~below(p, target), "Path is outside managed target directory root"))
    return first_of(cases)


def is_subclip(a: str = "") -> Column:
    """By trims or by name, as the viewer has it."""
    name = ascii_lower(F.col("display_name"))
    return by_trim() | name.contains("subclip") | name.contains("sub-clip")


def by_trim() -> Column:
    """A subclip by trims alone, as the overview counts it."""
    return (F.col("trim_in_ms") > 0) | ((F.col("trim_out_ms") > 0) & (F.col("trim_out_ms") < F.col("duration_ms")))


def trim_error(trim_in: Column, trim_out: Column, duration: Column) -> Column:
    out = F.when(trim_out <= 0, duration).otherwise(trim_out)
    return first_of([
        (trim_in < 0, "trim_in_negative"),
        (duration <= 0, "no_duration"),
        (out <= trim_in, "trim_out_not_after_trim_in"),
        (out > duration, "trim_out_exceeds_duration"),
    ])


def near_keyframe(keyframes: Column, ms: Column, num: Column, den: Column) -> Column:
    """Whether a keyframe lies within half a frame of ms."""
    half = F.lit(500.0) / rate(num, den)
    return F.exists(keyframes, lambda k: F.abs(k - ms).cast("double") <= half)


# Names of the retention periods, in days.
RETENTION = {"disabled": 0, "none": 0, "1week": 7, "7days": 7, "7d": 7, "2weeks": 14, "14days": 14, "14d": 14, "3weeks": 21, "21days": 21, "21d": 21, "1month": 30, "30days": 30, "30d": 30}


def retention_days(policy: Column, days: Column) -> Column:
    """Days of a policy by name, else of a number that is allowed, else 0; -1 for what is invalid."""
    named = F.coalesce(F.create_map(*(F.lit(x) for kv in RETENTION.items() for x in kv))[ascii_lower(policy)], F.lit(-1))
    return F.when(policy.isNotNull(), named).when(days.isNull(), 0).when(days.isin(0, 7, 14, 21, 30), days).otherwise(-1).cast("long")


def rate(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(25.0))


def snapped(num: Column, den: Column) -> tuple[Column, Column]:
    """Numerator and denominator of the broadcast rate within 0.05, the first that fits; 25/1 without a denominator."""
    fps = num.cast("double") / F.nullif(den, F.lit(0)).cast("double")
    near = [(F.abs(fps - r) < 0.05, n, d) for r, n, d in BROADCAST_RATES]
    return tuple(first_of([(den <= 0, F.lit(none).cast("long")), *((t, F.lit(v[k]).cast("long")) for t, *v in near)], given) for k, none, given in ((0, 25, num), (1, 1, den)))


def parsed_rate(text: Column) -> tuple[Column, Column]:
    """n/d as it stands, bad parts 25 and 1; a decimal as thousandths."""
    parts = F.split(text, "/")
    ratio = F.size(parts) == 2
    part = lambda k, bad: F.coalesce(F.when(F.get(parts, F.lit(k)).rlike("^[+-]?[0-9]+$"), F.get(parts, F.lit(k)).try_cast("long")), F.lit(bad).cast("long"))
    number = F.coalesce(text.try_cast("double"), F.lit(25.0))
    return F.when(ratio, part(0, 25)).otherwise(F.round(number * 1000).cast("long")), F.when(ratio, part(1, 1)).otherwise(F.lit(1000).cast("long"))


def gop(num: Column, den: Column) -> Column:
    g = F.round(rate(num, den) * 2).cast("long")
    return F.when(g > 0, g).otherwise(F.lit(50).cast("long"))


def profile(height: Column, field_order: Column) -> Column:
    interlaced = F.coalesce(field_order.isin("tt", "tb", "tff", "bff", "bb", "bt"), F.lit(False))
    return F.when((height > 900) & interlaced, "B").when(height > 900, "A").otherwise("C")


def request_hash(fingerprint: Column, frames: Column) -> Column:
    """Sixteen hexadecimal digits of the fingerprint xor the frames, rotated left by 13 bits."""
    turned = F.shiftleft(frames, 13) + F.shiftrightunsigned(frames, 51)
    return F.lower(F.lpad(F.hex(fingerprint.bitwiseXOR(turned)), 16, "0"))


def fingerprint(content: Column) -> Column:
    """The first eight bytes of the SHA-256 of size (little-endian) and content, or head, middle and tail of 64 KiB each."""
    chunk = 65536
    size = F.octet_length(content).cast("long")
    little = F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(size, 8 * k).bitwiseAND(255)), 2, "0") for k in range(8))))
    middle = (size / 2).cast("long") - chunk // 2
    long = F.concat(F.substring(content, 1, chunk), content.substr(middle.cast("int") + 1, F.lit(chunk)), content.substr((size - chunk).cast("int") + 1, F.lit(chunk)))
    hashed = F.sha2(F.concat(little, F.when(size <= 3 * chunk, content).otherwise(long)), 256)
    return F.conv(F.substring(hashed, 1, 16), 16, -10).cast("long")


def error_class(message: Column, validation: Column) -> Column:
    low = ascii_lower(message)
    return first_of([(validation, "Permanent"), *((any_of([low.contains(p) for p in parts]), name) for name, parts in ERROR_PARTS)], "Retryable")


def probe_mismatch(source_secs: Column, output_secs: Column, num: Column, den: Column) -> Column:
    """Whether the durations differ by more than two frames (40 ms at least)."""
    frame = F.when(rate(num, den) > 0, F.round(F.lit(1000.0) / rate(num, den))).otherwise(F.lit(40.0))
    return F.round(F.abs(output_secs - source_secs) * 1000) > F.greatest(frame * 2, F.lit(40.0))


def loudness_targets(mode: Column, i: Column, tp: Column, lra: Column) -> list[Column]:
    """Targets of a mode; overrides count for the two named modes."""
    out = []
    for k, given in enumerate((i, tp, lra)):
        out.append(first_of([(mode == name, F.coalesce(given, F.lit(v[k]))) for name, v in LOUDNESS.items()], LOUDNESS["ebu_r128"][k]))
    return out


def is_silent(i: Column) -> Column:
    return (i <= -70.0) | (F.abs(i) == F.lit(float("inf")))


def is_short(secs: Column) -> Column:
    return (secs > 0) & (secs < 3)


def is_linear(i: Column, tp: Column, lra: Column, secs: Column, target_i: Column, target_tp: Column, target_lra: Column) -> Column:
    fits = (tp + (target_i - i) <= target_tp + 0.001) & (lra <= target_lra * 1.5 + 0.001)
    return ~is_silent(i) & ~is_short(secs) & fits


def downmix(channels: Column, preserve: Column) -> Column:
    """The filter, or 'unsupported_audio_channel_layout'."""
    return first_of([
        (channels.isin(0, 2) | (channels.isin(1, 6, 8) & preserve), ""),
        (channels == 1, MONO_PAN),
        (channels == 6, SURROUND_PAN),
    ], "unsupported_audio_channel_layout")


def qc_findings(out_secs: Column, num: Column, den: Column, src_num: Column, src_den: Column, audio_rate: Column, gop_ok: Column, faststart_ok: Column, silent: Column, short: Column) -> Column:
    """Array of (severity, code), in the order of the checks."""
    finding = lambda test, severity, code: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    off = lambda n, d: F.abs(rate(n, d) - 25.0) > 0.01
    # The codes and their severities.
    return F.filter(
        F.array(
            finding(F.round(out_secs * 1000) <= 0, "error", "zero_duration"),
            finding(off(num, den), "error", "fps_mismatch"),
            finding(off(src_num, src_den), "warning", "fps_converted"),
            finding(audio_rate != 48000, "error", "audio_sample_rate_not_48k"),
            finding(~gop_ok, "error", "closed_gop_violation"),
            finding(~faststart_ok, "error", "missing_faststart"),
            finding(silent, "warning", "silent_audio_loudness_skipped"),
            finding(short & ~silent, "warning", "short_clip_loudnorm_dynamic"),
        ),
        lambda f: f.isNotNull(),
    )


def closed_gop(keyframes: Column, num: Column, den: Column) -> Column:
    """No two keyframes closer than the GOP less half a frame."""
    fps = rate(num, den)
    least = F.lit(1000.0) * gop(num, den) / fps - F.lit(500.0) / fps
    n = F.size(keyframes)
    gaps = F.when(n >= 2, F.zip_with(F.slice(keyframes, 2, n - 1), F.slice(keyframes, 1, n - 1), lambda b, a: b - a))
    return F.coalesce(F.forall(gaps, lambda g: g >= least), F.lit(True))


def has_faststart(content: Column) -> Column:
    return (F.octet_length(content) >= 16) & F.substring(content, 1, 65536).contains(F.lit(b"moov"))


def sanitized(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), "^_+|_+$", ""))


def sidecar_path(path: Column) -> Column:
    """Next to the video, or in sidecars/ beside a folder videos/."""
    beside = F.regexp_replace(path, "/videos/([^/]*)$", "/sidecars/$1")
    return F.concat(F.regexp_replace(beside, "\\.[^./]*$", ""), F.lit(".uuid.json"))


def state_of(phase: Column) -> Column:
    return first_of([(phase.isin(phases), state) for state, phases in PHASES_OF.items()], "Pending")


def may_follow(before: Column, after: Column) -> Column:
    return (before == after) | any_of([(before == p) & after.isin(q) for p, q in NEXT_PHASES.items() if q])


def progress_ms(line: Column) -> Column:
    part = lambda k: F.regexp_extract(line, "time=(\\d+):(\\d+):(\\d+)\\.(\\d+)", k).try_cast("long")
    return (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + part(4) * 10


def percent(ms: Column, duration: Column, frame: Column, frames: Column) -> Column:
    """By time, else by frames, at most 99."""
    return F.least(F.when((duration > 0) & (ms > 0), ms * 100.0 / duration).when(frames > 0, frame * 100.0 / frames).otherwise(F.lit(0.0)), F.lit(99.0))


def log_summary(lines: Column) -> Column:
    """The last line that says something, else the last that is not empty."""
    bare = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
    trimmed = F.transform(lines, bare)
    telling = F.filter(trimmed, lambda x: (F.octet_length(x) >= 6) & ~any_of([x.startswith(b) for b in BORING_LINES]))
    return F.coalesce(F.try_element_at(telling, F.lit(-1)), bare(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(-1))))


def json_strings(text: Column) -> Column:
    """An array of strings from JSON text; empty if any element is something else."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    parsed = F.from_json(text, "array<string>")
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(parsed, lambda x: x.isNull()), parsed).otherwise(F.array().cast("array<string>"))


def frame_trim(trim_in: Column, trim_out: Column, duration: Column, num: Column, den: Column) -> dict[str, Column]:
    """First frame, frame behind the last, and number of frames; null where the trim is empty or the rate invalid."""
    total = F.greatest(duration, F.lit(0))
    begin = F.least(F.greatest(trim_in, F.lit(0)), total)
    end = F.when((trim_out <= 0) | (trim_out > total), total).otherwise(trim_out)
    fps = num.cast("double") / F.nullif(den, F.lit(0)).cast("double")
    ok = (num > 0) & (den > 0) & (end > begin)
    first = F.floor(begin / 1000.0 * fps)
    last = F.least(F.ceil(end / 1000.0 * fps), F.round(total / 1000.0 * fps).cast("long"))
    return {"in_frame": F.when(ok, first).cast("long"), "out_frame": F.when(ok, last).cast("long"), "duration_frames": F.when(ok, F.greatest(last - first, F.lit(0))).cast("long")}


def play_command(channel: int, layer: int, path: Column, in_frame: Column, frames: Column) -> Column:
    return F.format_string(f'PLAY {channel}-{layer} "%s" SEEK %d LENGTH %d', path, in_frame, frames)
