"""Information-theoretic sanitisation of personal data, in DataFrame functions alone.

Protected entities are the values of four kinds that patterns find: e-mail addresses, IP addresses, payment cards (Luhn)
and telephone numbers. A text without them still discloses one if it holds a term that, in the corpus, stands beside this
value and hardly anywhere else. With N documents, n(c) of which hold entity c, n(t) the term t, and n(c,t) the term beside
the entity (among the NEAR terms before or behind a mention), the disclosure is the share of the entity's information
content that the term gives away, pointwise mutual information over information content:

    D(c;t) = ln(n(c,t) N / (n(c) n(t))) / ln(N / n(c)),  1 where the term stands beside that entity alone

A pair counts as evidence if SUPPORT different texts have it. A term with D >= DISCLOSED for any entity is sanitised
wherever it occurs: it is generalised to its class, the terms with the same first STEM letters, if the class, measured
in the same way, discloses no entity; else it is removed.

A term is a run of 4 to 40 letters, A-Z lower-cased. All counts are over all documents. The corpus is read four times:
for the entities with their neighbours, for n(t) of the terms that have evidence, for the texts that hold a disclosing
term, and for the result. Rows that move are pairs beside mentions, counts, and (text hash, term) of disclosing terms;
texts move only where so many texts hold disclosing terms that their list is above BROADCAST. Neither a hot entity nor a
hot text gathers in a task: counts are combined before each shuffle.

Patterns are matched as stated, leftmost and without overlap per kind, in linear time: a run of characters is entered at
its first one or at the end of the last match, where the leftmost match must begin, and repeats give nothing back.

Defined results: a null text is empty; a null doc_id is kept; each copy of a repeated row is a document of its own for
N and n, and one text for SUPPORT; an empty table gives an empty result; further columns are ignored, whatever their
names. Terms within a base span are not reported again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ready, scratch, stored

NEAR = 5
SUPPORT = 3
DISCLOSED = 0.9
STEM = 3
BROADCAST = 200_000  # rows of at most some 200 bytes; beyond, both sides are shuffled
SALTS = 32
ASIDE = 200  # characters of a gap between mentions that are looked at for neighbours
CHUNK = 64
KINDS = ("email", "ip", "card", "phone")
#: The patterns of the four kinds.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A sign that every match of the kind has, looked for first.
SIGNS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
AT_MOST_255 = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
LETTERS = r"\p{L}+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an array of whole numbers (0 and more) all up to it joined, by + or by the greater: in chunks,
    which then take up what stands before them, so that no long array is copied for each of its entries."""
    none, zero = F.array().cast("array<long>"), F.lit(0).cast("long")

    def folded(a: Column, entry: Callable[[Column], Column], before: bool) -> Column:
        def step(acc: Column, x: Column) -> Column:
            s = joined(acc["s"], entry(x))
            return F.struct(s.alias("s"), F.array_append(acc["a"], acc["s"] if before else s).alias("a"))

        return F.aggregate(a, F.struct(zero.alias("s"), none.alias("a")), step, lambda acc: acc["a"])

    def all_of(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda c: F.slice(a, c * CHUNK + 1, CHUNK))
        shifted = lambda parts, before: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: joined(F.get(before, i), x))))
        return let(F.transform(chunks, lambda c: folded(c, lambda x: x, False)), lambda parts: let(folded(parts, lambda p: F.element_at(p, -1), True), lambda before: shifted(parts, before)))

    return let(values, lambda a: F.when(F.size(a) > 0, all_of(a)).otherwise(none))


def ends_of(matches: Column, gaps: Column) -> Column:
    """Where each match ends; gaps are what stands before, between and behind the matches."""
    return running(F.transform(matches, lambda x, i: (F.length(F.get(gaps, i)) + F.length(x)).cast("long")), lambda a, b: a + b)


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is divisible by ten."""
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    digit = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when((F.length(digits) - i) % 2 == 0, digit(i)).otherwise(doubled(digit(i)))) % 10 == 0


def plain(kind: str, found: Column) -> Column:
    """A found value in the form in which it is the same entity."""
    if kind == "email":
        return lowered(found)
    return found if kind == "ip" else F.translate(found, "+ ().-", "")


def valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(AT_MOST_255)
    low, high = (13, 19) if kind == "card" else (9, 15)
    fits = F.length(plain(kind, found)).between(low, high)
    return F.when(fits, luhn(plain(kind, found))).otherwise(False) if kind == "card" else fits


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


SPAN = "array<struct<kind:string,start:long,end:long,value:string,before:string,behind:string>>"


def spans_of(kind: str, text: Column, aside: int = 0) -> Column:
    """All valid matches of a kind: kind, start, end, value, and up to aside characters of the gaps on both sides."""
    pattern = F.lit(PATTERNS[kind])

    def placed(matches: Column, gaps: Column) -> Column:
        def span(ends: Column) -> Callable[[Column, Column], Column]:
            def one(x: Column, i: Column) -> Column:
                end = F.get(ends, i)
                before, behind = (F.right(F.get(gaps, i), F.lit(aside)), F.left(F.get(gaps, i + 1), F.lit(aside))) if aside else (F.lit(""), F.lit(""))
                return F.struct(F.lit(kind).alias("kind"), (end - F.length(x)).alias("start"), end.alias("end"), x.alias("value"), before.alias("before"), behind.alias("behind"))

            return one

        return F.filter(let(ends_of(matches, gaps), lambda e: F.transform(matches, span(e))), lambda s: valid(kind, s["value"]))

    none = F.array().cast(SPAN)
    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, PATTERNS[kind], -1), lambda g: placed(m, g).cast(SPAN))).otherwise(none))
    return F.when(F.contains(text, F.lit(SIGNS[kind])), found).otherwise(none) if SIGNS[kind] else found


def terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(lowered(text), F.lit(LETTERS), F.lit(0)), lambda w: F.length(w).between(4, 40))


def with_classes(words: Column) -> Column:
    """Terms, and behind them their classes."""
    return F.concat(words, F.transform(words, lambda w: F.concat(F.left(w, F.lit(STEM)), F.lit("*"))))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _beside(span: str) -> Column:
    """Keys of the terms beside a mention; a word that the cut of a gap may have broken is left out."""
    before, behind = F.col(f"{span}.before"), F.col(f"{span}.behind")
    whole_before = F.when(F.length(before) < ASIDE, before).otherwise(F.regexp_replace(before, r"^\p{L}+", ""))
    whole_behind = F.when(F.length(behind) < ASIDE, behind).otherwise(F.regexp_replace(behind, r"\p{L}+$", ""))
    last = let(terms(whole_before), lambda t: F.slice(t, F.greatest(F.size(t) - NEAR + 1, F.lit(1)), F.lit(NEAR)))
    return F.array_append(with_classes(F.concat(last, F.slice(terms(whole_behind), 1, NEAR))), F.lit(""))  # '' stands for the entity itself


def evidence(docs: DataFrame) -> DataFrame:
    """entity, key, n: documents that have the key beside the entity; the key '' counts those that have the entity. Pairs
    of fewer than SUPPORT different texts are left out."""
    base = F.concat(*(spans_of(k, F.col("text"), ASIDE) for k in KINDS))
    rows = _texts(docs).select(F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("copy"), base.alias("base")).where(F.size("base") > 0)
    rows = rows.select("row", "copy", F.explode("base").alias("m"))
    value = F.coalesce(*(F.when(F.col("m.kind") == k, plain(k, F.col("m.value"))) for k in KINDS))
    pairs = rows.select("row", "copy", F.concat_ws(":", "m.kind", value).alias("entity"), F.explode(_beside("m")).alias("key")).distinct()
    texts = pairs.groupBy("entity", "key", "copy").agg(F.count("*").alias("n"))
    return texts.groupBy("entity", "key").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT).select("entity", "key", "n")


def _small(df: DataFrame) -> DataFrame:
    """df to be joined with: broadcast if it has at most BROADCAST rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df.hint("shuffle_hash")


def disclosing(docs: DataFrame, under: str) -> DataFrame:
    """term and replacement ('' where it is removed) of all terms that disclose an entity."""
    found = stored(evidence(docs), "evidence", under)
    wanted = found.where("key <> ''").select("key").distinct()
    counted = _texts(docs).select(F.explode(F.array_distinct(with_classes(F.array_distinct(terms(F.col("text")))))).alias("key"))
    common = counted.join(_small(stored(wanted, "keys", under)), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n_key"))
    total = docs.count()
    entities = found.where("key = ''").select("entity", F.col("n").alias("n_entity")).where(F.col("n_entity") < total)
    pairs = found.where("key <> ''").join(entities, "entity").join(stored(common, "common", under), "key")
    share = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_entity").cast("double") * F.col("n_key"))) / F.log(F.lit(float(total)) / F.col("n_entity"))
    told = stored(pairs.where(share >= DISCLOSED).select("key").distinct(), "told", under)
    classes = told.where(F.endswith("key", F.lit("*"))).select(F.col("key").alias("class"), F.lit(True).alias("tells"))
    single = told.where(~F.endswith("key", F.lit("*"))).select(F.col("key").alias("term"), F.concat(F.left("key", F.lit(STEM)), F.lit("*")).alias("class"))
    return stored(single.join(classes, "class", "left").select("term", F.when(F.col("tells"), F.lit("")).otherwise(F.col("class")).alias("replacement")), "terms", under)


def _hits(docs: DataFrame, told: DataFrame, under: str) -> DataFrame:
    """copy (a text's hash) and the disclosing terms that its texts hold. Two texts of one hash would look for each
    other's terms, too, which finds what is there and no more."""
    words = _texts(docs).select(F.xxhash64("text").alias("copy"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    rows = words.join(_small(told), "term").distinct()
    return stored(rows.groupBy("copy").agg(F.sort_array(F.collect_list(F.struct("term", "replacement"))).alias("told")), "hits", under)


def _term_spans(text: Column, told: Column, base: Column) -> Column:
    """Places of the terms of told in text that no base span touches: start, end, replacement."""
    pattern = F.concat(F.lit(r"(?i)(?<!\p{L})(?:"), F.array_join(F.transform(told, lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    kind = "array<struct<start:long,end:long,replacement:string>>"

    def placed(p: Column) -> Column:
        def spans(m: Column, ends: Column) -> Column:
            return F.transform(m, lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), F.element_at(F.map_from_entries(told), lowered(x)).alias("replacement")))

        return let(F.regexp_extract_all(text, p, F.lit(0)), lambda m: let(F.split(text, p, -1), lambda g: let(ends_of(m, g), lambda e: spans(m, e))))

    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.when(told.isNotNull(), F.filter(let(pattern, placed), free).cast(kind)).otherwise(F.array().cast(kind))


def _cut(text: Column, spans: Column) -> Column:
    """text with each span (start, end, put) replaced; spans that overlap are one, with what the first of them puts.
    Parts are cut from four bytes a character, so that a part costs its own length."""

    def parts(wide: Column, s: Column, reach: Column, heads: Column) -> Column:
        piece = lambda a, b: F.decode(F.substr(wide, (4 * a + 1).cast("int"), (4 * (b - a)).cast("int")), "UTF-32")
        behind = lambda h: F.get(reach, F.coalesce(F.get(heads, h + 1), F.size(s)) - 1)  # noqa: E731  # end of the h-th stretch
        ahead = F.transform(heads, lambda k, h: F.concat(piece(F.when(h > 0, behind(h - 1)).otherwise(F.lit(0)), F.get(s, k)["start"]), F.get(s, k)["put"]))
        return F.concat(F.array_join(ahead, ""), piece(F.element_at(reach, -1), F.length(text)))

    def cut(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        heads = lambda r: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k)["start"] >= F.get(r, k - 1)))
        return let(reach, lambda r: let(heads(r), lambda h: let(F.encode(text, "UTF-32"), lambda w: parts(w, s, r, h))))

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), cut)).otherwise(text)


def sanitised(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base (kind, start, end of each base span, by kind and start), terms (start, end,
    replacement of each disclosing term, by start) and sanitised, the text with base spans replaced by their kind in
    angle brackets and terms generalised or removed. Places are code points, ends exclusive."""
    ready(docs.sparkSession)
    with scratch(docs.sparkSession) as under:
        told = disclosing(docs, under)
        hits = stored(_hits(docs, told, under), "told")
    rows = _texts(docs).withColumn("copy", F.xxhash64("text"))
    if (hits.agg(F.sum(F.size("told"))).first()[0] or 0) <= BROADCAST:
        rows = rows.join(F.broadcast(hits), "copy", "left")
    else:  # rows of one text are dealt over SALTS groups
        salted = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["copy", "salt"], "left").drop("salt")
    kind = "array<struct<kind:string,start:long,end:long>>"
    base = F.concat(*(F.transform(spans_of(k, F.col("text")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS))
    rows = rows.select("doc_id", "text", "told", base.cast(kind).alias("base"))
    rows = rows.select("doc_id", "text", "base", _term_spans(F.col("text"), F.col("told"), F.col("base")).alias("terms"))
    put = F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.concat(F.lit("<"), b["kind"], F.lit(">")).alias("put"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["replacement"].alias("put"))),
    )
    return rows.select("doc_id", "base", "terms", _cut(F.col("text"), put).alias("sanitised"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of these spans, and all spans as text."""
    listed = lambda spans, kind: F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"]))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = listed("base", lambda s: s["kind"])
    every = F.concat(base, listed("terms", lambda s: F.lit("term")))
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
