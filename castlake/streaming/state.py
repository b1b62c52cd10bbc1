"""Stateful stream operators, each with the batch twin that defines its result: settled files, throttled ticks, job phases,
leases, merged channels, the last lines of logs. Batch twins are window functions where these can say it, else folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import NEXT_PHASES
from .fold import Fold, folded, in_order

UNSEEN = (None, None, 0, 0, 0, None, None)
FIRST_PHASE, ENDS = "queued", ("completed", "failed", "cancelled")
STDERR_LINES, LOG_LINES = 200, 500


# settled files
def settling(polls: int = 2, settle_secs: int = 5, gone_ms: int | None = None) -> Fold:
    """Polls of a file (now, scan, size, mtime): growth starts anew without counting, equal size and mtime counts one up,
    else counts from one; a file begins with size 0, so its first sight is growth. Sent once for each (size, mtime), when
    it was seen often enough and is old enough. A scan without the file ends all that is known of it: scans are numbered
    one by one, so a leap in them says so when the file is back, and after gone_ms of event time without it the state is
    dropped."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        now, scan, size, mtime = row
        if None not in (scan, state[1]) and scan > state[1] + 1:
            state = UNSEEN
        _, _, last_size, last_mtime, n, *sent = state
        if size > last_size:
            return (now, scan, size, mtime, 0, *sent), []
        n = n + 1 if (size, mtime) == (last_size, last_mtime) else 1
        if n >= polls and now - mtime >= settle_secs and [size, mtime] != sent:
            return (now, scan, size, mtime, n, size, mtime), [(size, mtime, n)]
        return (now, scan, size, mtime, n, *sent), []

    deadline = (lambda s: None if s[0] is None else s[0] * 1000 + gone_ms) if gone_ms else None
    return Fold("now long, scan long, size long, mtime long, polls long, sent_size long, sent_mtime long", "size long, mtime long, polls long", UNSEEN, step, deadline=deadline)


def settled_stream(listing: DataFrame, polls: int = 2, settle_secs: int = 5, delay: str = "10 seconds", gone_ms: int = 600_000) -> DataFrame:
    """listing: path, size, mtime, at (a timestamp), scan: a stream of scans. Gives path, size, mtime, polls."""
    rows = listing.withColumn("now", F.unix_seconds("at"))
    return in_order(rows, "path", settling(polls, settle_secs, gone_ms), ["now", "scan", "size", "mtime"], "at", delay)


def settled_batch(listing: DataFrame, polls: int = 2, settle_secs: int = 5) -> DataFrame:
    """listing: path, size, mtime, now (in seconds) and, where files come and go, scan (numbered one by one)."""
    scan = F.col("scan") if "scan" in listing.columns else F.lit(None).cast("long")
    by_path = Window.partitionBy("path").orderBy("now")
    of = lambda *keys: Window.partitionBy("path", *keys).orderBy("now")
    away = F.coalesce(scan > F.lag(scan).over(by_path) + 1, F.lit(False))
    rows = listing.select("path", "size", "mtime", "now", F.sum(away.cast("int")).over(by_path).alias("stay"))
    size, mtime = F.coalesce(F.lag("size").over(of("stay")), F.lit(0)), F.coalesce(F.lag("mtime").over(of("stay")), F.lit(0))
    change = F.when(F.col("size") > size, 2).when((F.col("size") != size) | (F.col("mtime") != mtime), 1).otherwise(0)
    rows = rows.withColumn("change", change).withColumn("run", F.sum((F.col("change") > 0).cast("int")).over(of("stay")))
    # a run begins with no poll after growth, with one after another change; the files of run 0 are empty from the start
    begin = F.when(F.first("change").over(of("stay", "run")) == 2, 1).otherwise(0)
    rows = rows.withColumn("polls", (F.row_number().over(of("stay", "run")) - begin).cast("long"))
    ripe = rows.where((F.col("polls") >= F.greatest(F.lit(polls), F.lit(1))) & (F.col("now") - F.col("mtime") >= settle_secs) & ((F.col("change") == 0) | (F.col("polls") == 1)))
    first = ripe.groupBy("path", "stay", "run").agg(F.min_by(F.struct("size", "mtime", "polls"), "now").alias("s"), F.min("now").alias("now"))
    before = F.lag("s").over(of("stay"))
    again = (before["size"] == F.col("s.size")) & (before["mtime"] == F.col("s.mtime"))
    return first.withColumn("again", F.coalesce(again, F.lit(False))).where(~F.col("again")).select("path", "s.size", "s.mtime", "s.polls")


# throttled ticks
def throttle(gap_ms: int) -> Fold:
    """Ticks (at_ms, percent) that are sent: the first, each that comes gap_ms or more behind the last sent one, and all
    of 100 %."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        if state[0] is None or row[0] - state[0] >= gap_ms or (row[1] is not None and row[1] >= 100):
            return (row[0],), [row]
        return state, []

    return Fold("last long", "at_ms long, percent double", (None,), step)


def throttled_batch(ticks: DataFrame, gap_ms: int = 250) -> DataFrame:
    """ticks: key, at_ms, percent."""
    return folded(ticks, "key", throttle(gap_ms), ["at_ms", "percent"], 2)


def throttled_stream(ticks: DataFrame, gap_ms: int = 250, delay: str = "10 seconds") -> DataFrame:
    """ticks: key, at (a timestamp), percent."""
    return in_order(ticks.withColumn("at_ms", F.unix_millis("at")), "key", throttle(gap_ms), ["at_ms", "percent"], "at", delay, 2)


# job phases
def phases() -> Fold:
    """Events (seq, phase) of a job: its phase, how many were applied, how many rejected as they may not follow, the first
    event out of the queue, and the last end."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (phase, applied, rejected, started, finished), (seq, asked) = state, row
        if asked != phase and asked not in NEXT_PHASES[phase]:
            return (phase, applied, rejected + 1, started, finished), []
        started = seq if started is None and asked != FIRST_PHASE else started
        return (asked, applied + 1, rejected, started, seq if asked in ENDS else finished), []

    columns = "phase string, applied long, rejected long, started long, finished long"
    return Fold(columns, columns, (FIRST_PHASE, 0, 0, None, None), step, final=lambda s: [s])


def job_phases(events: DataFrame) -> DataFrame:
    """The phase of each job after its events (id, seq, phase), in the order of seq."""
    return folded(events, "id", phases(), ["seq", "phase"])


def job_phases_stream(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """events: id, seq, phase, at (a timestamp). A row for a job whenever events of it were applied; that with the most
    applied and rejected is the last."""
    return in_order(events, "id", phases(), ["seq", "phase"], "at", delay)


# leases
def leasing(lease_ms: int) -> Fold:
    """Heartbeats (at_ms, worker, ended) of a job: each holds the lease for lease_ms, an end gives it up. Sent: worker and
    end of leases that ran out."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (worker, until), (at, name, ended) = state, row
        out = [(worker, until)] if until is not None and at > until else []
        return ((None, None) if ended else (name, at + lease_ms)), out

    return Fold("worker string, until long", "worker string, expired_at long", (None, None), step, deadline=lambda s: s[1], over=lambda s: [s])


def expired_leases(beats: DataFrame, lease_ms: int, now_ms: int) -> DataFrame:
    """beats: id, at_ms, worker, ended. Leases that ran out before the next heartbeat, or before now."""
    w = Window.partitionBy("id").orderBy("at_ms", "worker", "ended")
    until = F.col("at_ms") + lease_ms
    rows = beats.select("id", "worker", "ended", until.alias("expired_at"), F.coalesce(F.lead("at_ms").over(w), F.lit(now_ms)).alias("next"))
    return rows.where(~F.col("ended") & (F.col("next") > F.col("expired_at"))).select("id", "worker", "expired_at")


def expired_leases_stream(beats: DataFrame, lease_ms: int, delay: str = "10 seconds") -> DataFrame:
    """beats: id, at (a timestamp), worker, ended. A lease is sent when the watermark has passed it, with or without input
    for its job."""
    return in_order(beats.withColumn("at_ms", F.unix_millis("at")), "id", leasing(lease_ms), ["at_ms", "worker", "ended"], "at", delay, 3)


# channels
def merged_channels(found: DataFrame, retried: DataFrame, within_ms: int) -> DataFrame:
    """path, at_ms, channel of both; a path that comes again, from either, within within_ms of the one that was taken
    comes once. Of equal times the retry is taken."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        if state[0] is None or row[0] - state[0] > within_ms:
            return (row[0],), [row]
        return state, []

    both = found.select("path", "at_ms", F.lit("watch").alias("channel")).unionByName(retried.select("path", "at_ms", F.lit("retry").alias("channel")))
    return folded(both, "path", Fold("taken long", "at_ms long, channel string", (None,), step), ["at_ms", "channel"], 2)


def merged_channels_stream(found: DataFrame, retried: DataFrame, within: str) -> DataFrame:
    """path, at, channel of two streams with path and at; a path that is re-listed and retried within the time comes once."""
    both = found.select("path", "at", F.lit("watch").alias("channel")).unionByName(retried.select("path", "at", F.lit("retry").alias("channel")))
    return both.withWatermark("at", within).dropDuplicatesWithinWatermark(["path"])


# last lines
def log_text(lines: DataFrame, name: str = "line") -> DataFrame:
    """Lines without their ends; empty ones are left out."""
    return lines.withColumn(name, F.regexp_replace(name, "[\\r\\n]+$", "")).where(F.col(name) != "")


def log_line(at: str, level: str, message: str):
    """A line as the log shows it."""
    return F.concat(F.date_format(at, "HH:mm:ss"), F.lit(" ["), F.upper(level), F.lit("] "), F.col(message))


def ring(n: int) -> Fold:
    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        return ([*state[0], row[1]][-n:],), []

    return Fold("lines array<string>", "lines array<string>", ([],), step, final=lambda s: [(list(s[0]),)])


def last_lines(lines: DataFrame, n: int = STDERR_LINES) -> DataFrame:
    """The last n lines of each key in their order. lines: key, seq, line."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    kept = lines.withColumn("k", newest).where(F.col("k") <= n)
    return kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("lines"))


def last_lines_stream(lines: DataFrame, n: int = STDERR_LINES, delay: str = "10 seconds") -> DataFrame:
    """lines: key, seq, line, at (a timestamp). The last n lines of a key whenever lines of it came."""
    return in_order(lines, "key", ring(n), ["seq", "line"], "at", delay)
