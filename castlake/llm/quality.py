"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each text gets counts (words, their characters, signs, repeated lines, words in repeated three-word windows), and from
these a few signals that are high in junk. A rule has a cutoff for each signal and rejects a text with any signal over its
own; the rules of LEVELS, from the loosest to the strictest, are tried on labelled documents for each stratum (language).
With n good ones, x of which a rule rejects, the rule is certified if the exact binomial probability of x or fewer
rejections, were the true rate ALPHA, is at most DELTA divided by the number of strata (Bonferroni). Within a stratum the
rules are tested in their fixed order and the first that fails ends the sequence, so no factor is due for their number.
So with probability 1 - DELTA, in every stratum at once, the rule in use rejects at most the share ALPHA of good
documents. Of the certified rules the one that rejects most documents labelled bad is used, the loosest of equals; a
stratum without one (under about 150 to 230 good documents) has the base rule alone.

The labelled documents are taken as independent trials: each doc_id counts once (bad if any of its labels says so), and of
equal texts of a stratum only the one of the least doc_id.

Defined results: a null text has no words and fails the base rule; a null language is a stratum of its own; labels that
are null or of unknown documents are left out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

ALPHA = 0.02
DELTA = 0.05
BROADCAST = 100_000  # strata with a cutoff that are broadcast, some 40 bytes each; beyond, both sides are shuffled
SALTS = 64  # groups that the rows of a stratum are dealt over then
#: Cutoffs of each signal, from the loosest rule to the strictest.
LEVELS = {
    "symbols": (0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01),
    "shouts": (0.2, 0.1, 0.05, 0.04, 0.03, 0.02, 0.01, 0.005),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeats": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
}
RULES = 8
BLANK = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Signals: shares of signs, of exclamation marks and capitals among word characters, of repeated lines, of repeated words.
SIGNALS = {
    "symbols": "n_symbols / word_chars",
    "shouts": "n_shouts / word_chars",
    "capitals": "n_capitals / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
}


def _without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of every row of docs."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("stratum"),  # a null language is not the empty one
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    solid = _without(F.col("text"), BLANKS)
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(_without(x, BLANKS)) > 0)
    words = F.filter(F.split("text", BLANK, -1), lambda w: w != "")
    step = base.select(
        "doc_id",
        "stratum",
        F.xxhash64("text").alias("copy"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(_without(F.col("text"), "!"))).cast("long").alias("n_shouts"),
        (F.length("text") - F.length(_without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_capitals"),
        lines.alias("lines"),
        words.alias("words"),
    )
    step = step.select(
        "*",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        # a 64-bit hash of each three-word window, by the place of its first word
        F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2))))
        .otherwise(F.array().cast("array<long>"))
        .alias("windows"),
    ).drop("lines", "words")
    # places of windows that occur twice or more, in order; each covers three words, less what the next one covers
    twice = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:long,i:int>>"))
    step = step.withColumn("placed", twice).drop("windows")
    again = F.filter(
        F.transform("placed", lambda x, k: F.when((F.get("placed", k - 1)["h"] == x["h"]) | (F.get("placed", k + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    step = step.withColumn("again", F.sort_array(again)).drop("placed")
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return step.withColumn("n_repeat_words", covered).drop("again")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def signal(expression: str) -> Column:
    """A share; 0 where there is nothing to share."""
    over, under = expression.split(" / ")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def binomial_cdf(x: Column, n: Column, p: float) -> Column:
    """P(X <= x) of a binomial (n, p), summed exactly; 1 from the mean on, where no test passes."""
    log_odds = F.log(F.lit(p)) - F.log(F.lit(1 - p))
    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(
        F.when(x > 0, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<long>")),
        F.struct(first.alias("t"), F.exp(first).alias("s")),
        lambda acc, i: F.struct((acc["t"] + F.log((n - i + 1) / i) + log_odds).alias("t"), (acc["s"] + F.exp(acc["t"] + F.log((n - i + 1) / i) + log_odds)).alias("s")),
        lambda acc: acc["s"],
    )
    return F.when(x >= n * p, F.lit(1.0)).otherwise(total)


def level() -> Column:
    """The number of the loosest rule that rejects a text; RULES if none does."""
    each = [sum((signal(e) <= c).cast("int") for c in LEVELS[name]) for name, e in SIGNALS.items()]
    return F.least(*each)


def cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and rule: the number of the certified rule that is used; strata without one are left out."""
    given = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = features.where(~base_failed()).select("doc_id", "stratum", "copy", level().alias("level")).join(given, "doc_id")
    once = known.groupBy("stratum", "copy").agg(F.min(F.struct("doc_id", "quality", "level")).alias("d"))
    counts = once.groupBy("stratum", F.col("d.level").alias("level")).agg(F.count_if(F.col("d.quality") == 1).alias("good"), F.count_if(F.col("d.quality") == 0).alias("bad"))
    counts = stored(counts, "levels")  # at most RULES + 1 rows of a stratum
    sizes = counts.groupBy("stratum").agg(F.sum("good").alias("n"))
    rules = sizes.withColumn("rule", F.explode(F.sequence(F.lit(0), F.lit(RULES - 1))))
    at = lambda c: F.sum(F.when(F.col("level") <= F.col("rule"), F.col(c)).otherwise(F.lit(0))).alias(c)
    rejected = rules.join(counts, "stratum").groupBy("stratum", "rule", "n").agg(at("good"), at("bad"))
    judged = rejected.withColumn("passes", binomial_cdf(F.col("good"), F.col("n"), alpha) <= delta / max(1, sizes.count()))
    ends = judged.groupBy("stratum").agg(F.coalesce(F.min(F.when(~F.col("passes"), F.col("rule"))), F.lit(RULES)).alias("end"))
    best = judged.join(ends, "stratum").where("rule < end and bad > 0").groupBy("stratum").agg(F.max(F.struct(F.col("bad"), (-F.col("rule")).alias("loose"))).alias("b"))
    return best.select("stratum", (-F.col("b.loose")).alias("rule"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed and kept of every row of docs."""
    features = stored(counted(docs), "features")
    chosen = stored(cutoffs(features, labels), "cutoffs")
    if chosen.count() <= BROADCAST:
        out = features.join(F.broadcast(chosen), "stratum", "left")
    else:  # the rows of a stratum are dealt over SALTS groups
        salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = features.withColumn("salt", F.pmod(F.xxhash64("copy", "doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["stratum", "salt"], "left").drop("salt")
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(level() <= F.col("rule"), F.lit(False)))
