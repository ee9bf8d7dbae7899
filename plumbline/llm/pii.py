"""Personal data: fixed patterns first, then identifiers that bootstrapped contexts give away. DataFrame functions only.

Base spans come from four patterns (email, ip, card, phone) with their checks. All identifier-like pieces of a text
(tokens with a digit or an at sign, spaced numbers) are its units. A unit that is a base entity is a seed. Seeds
induce lexical patterns: the unit's shape, the words before it with its shape or its class, the word after it.
Patterns and the distinct strings that they match form a graph, and Spark scores both sides in turn: a pattern's
confidence in a kind is RlogF, the share of its strings that are of the kind, by their scores, times the binary
logarithm of their number; a string's score is one less the product of what its accepted patterns leave open.
Only patterns above `least` with enough support are accepted; strings of a score of at least `accept` become
spans of the kind. Base spans always stay, and a unit that touches one is not added.

Start and end count code points. Nulls: a null text is empty; a null doc_id is kept. Repeated rows get equal
results, an empty table none. Only doc_id and text are read. Texts are read whole; patterns are possessive and
guarded, so long runs of one kind of character take linear time and no deep recursion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, written

KINDS = ["email", "ip", "card", "phone"]
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The contract's patterns, each started only where a match can begin.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]++)++",
}
#: Zeros in front, then at most 255; or zeros alone.
BYTE = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
GAP, INK = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"
UNIT = rf"(?:{PATTERNS['phone']})|(?<![{LABEL}])[0-9]{{2,}}+(?:[\x20-][0-9]{{2,}}+){{2,}}+|(?<!{INK}){INK}*?[0-9@]{INK}*+"
TRIM_LEFT, TRIM_RIGHT = r"^[\"'(\[<{,.;:!?#*$%&|=]++", r"[\"')\]>},.;:!?#*$%&|=]++$"
BLOCK = 256


def running(lengths: Column) -> Column:
    """Sums of all elements before each, in blocks so that the work stays near linear. Pass a column, not an expression."""
    sums = lambda x: F.aggregate(x, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    blocks = F.when(n > 0, blocks).otherwise(F.array().cast("array<array<bigint>>"))
    total = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v))
    return F.flatten(F.zip_with(blocks, F.slice(sums(total), 1, F.size(blocks)), lambda x, o: F.transform(F.slice(sums(x), 1, F.size(x)), lambda v: v + o)))


def luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    kept = F.filter(kind, lambda m: valid(kind, m["match"]))
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def located(df: DataFrame, name: str, pattern: str, may: Column) -> DataFrame:
    """df with `name`: (match, start, end, before, after) of each match of `pattern` in column text, where `may` holds."""
    text = F.when(may, F.col("text")).otherwise(F.lit(""))
    df = df.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), 0)).withColumn("_p", F.split(text, pattern, -1))
    steps = F.zip_with("_m", F.slice("_p", 1, F.size("_m")), lambda m, p: (F.length(p) + F.length(m)).cast("long"))
    df = df.withColumn("_s", steps).withColumn("_r", running(F.col("_s")))
    each = F.zip_with(F.arrays_zip("_m", "_r", "_p"), F.slice("_p", 2, F.size("_m")), lambda x, after: F.struct(
        x["_m"].alias("match"), (x["_r"] + F.length(x["_p"])).alias("start"), (x["_r"] + F.length(x["_p"]) + F.length(x["_m"])).alias("end"), x["_p"].alias("before"), after.alias("after")))
    return df.withColumn(name, F.filter(F.slice(each, 1, F.size("_m")), lambda x: x["match"].isNotNull())).drop("_m", "_p", "_s", "_r")


def spans_and_units(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's hash), base: (start, kind, end) sorted; units: what may be an identifier, with its surroundings."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    x = x.withColumn("key", F.xxhash64("text"))
    digit = F.col("text").rlike("[0-9]")
    may = {"email": F.col("text").contains("@"), "ip": digit, "card": digit, "phone": F.col("text").contains("+")}
    for kind in KINDS:
        x = located(x, kind, PATTERNS[kind], may[kind])
        x = x.withColumn(kind, _checked(kind))
    x = located(x, "units", UNIT, digit | may["email"])
    words = lambda s: F.filter(F.split(F.lower(s), f"[{GAP}]+"), lambda w: w != "")
    # a slice from the end fails on shorter arrays, so two blank words stand in front
    words2 = lambda s: F.concat(F.array(F.lit(""), F.lit("")), words(s))
    near = lambda m: F.struct(
        m["match"].alias("match"), m["start"].alias("start"),
        F.slice(words2(m["before"]), -2, 2).alias("two"),
        F.lower(F.regexp_extract(m["after"], f"^[{GAP}]*+({INK}++)", 1)).alias("next"),
    )
    return x.select("doc_id", "key", F.array_sort(F.concat(*KINDS)).alias("base"), F.transform("units", near).alias("units"))


def unit_rows(x: DataFrame) -> DataFrame:
    """One row a unit: its core, place, shape, surroundings, and kind if it is a seed; touched units that are no seeds are left out."""
    u = x.select("key", "base", F.explode("units").alias("u")).select("key", "base", "u.*")
    u = u.withColumn("core", F.regexp_replace(F.regexp_replace("match", TRIM_LEFT, ""), TRIM_RIGHT, ""))
    u = u.withColumn("start", F.col("start") + F.length("match") - F.length(F.regexp_replace("match", TRIM_LEFT, "")))
    u = u.withColumn("end", F.col("start") + F.length("core")).where(F.length("core") >= 6)
    inside = F.filter("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    u = u.withColumn("inside", inside)
    exact = F.filter("inside", lambda b: (b["start"] == F.col("start")) & (b["end"] == F.col("end")))
    u = u.withColumn("kind", F.try_element_at(exact, F.lit(1))["kind"]).where(F.col("kind").isNotNull() | (F.size("inside") == 0))
    shape = reduce(lambda s, r: F.regexp_replace(s, *r), [(r"\p{Lu}++", "A"), (r"\p{Ll}++", "a"), ("[0-9]", "9")], F.col("core"))
    kind_of = F.when(F.col("core").contains("@"), "at").when(F.regexp_replace("core", r"[0-9\x20().+-]", "") == "", "digits").otherwise("mixed")
    return u.select("key", "start", "end", "core", "kind", shape.alias("shape"), kind_of.alias("class"), F.array_join("two", " ").alias("two"), F.element_at("two", -1).alias("one"), "next")


def bootstrap(units: DataFrame, rounds: int = 3, least: float = 0.5, support: float = 3.0, accept: float = 0.5) -> DataFrame:
    """(core, kind): the distinct strings that patterns found, beyond the seeds."""
    part = lambda tag, *cols: F.concat_ws("\x1f", F.lit(tag), *cols)
    patterns = F.array(part("shape", "shape"), part("before", "two", "class"), part("word", "one", "shape"), part("after", "next", "shape"))
    edges = written(units.select("core", F.explode(patterns).alias("pattern")).distinct(), "pii-edges")
    seeds = written(units.where("kind is not null").select("core", "kind").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scores = seeds
    for _ in range(rounds):
        found = edges.join(scores, "core").groupBy("pattern", "kind").agg(F.sum("score").alias("f"))
        trust = found.join(sizes, "pattern").withColumn("trust", F.col("f") / F.col("n") * F.log2(F.col("f") + 1))
        trust = trust.where((F.col("trust") >= least) & (F.col("f") >= support))
        # a pattern speaks for its best kind; a confidence above one counts as nearly certain
        best = trust.groupBy("pattern").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"), F.max("trust").alias("trust"))
        open_ = F.log(1 - F.least(F.col("trust"), F.lit(0.95)))
        told = edges.join(best, "pattern").groupBy("core", "kind").agg((1 - F.exp(F.sum(open_))).alias("score"))
        told = told.join(seeds.select("core"), "core", "left_anti")
        told = told.groupBy("core").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
        scores = written(seeds.unionByName(told), "pii-scores")
    return scores.join(seeds.select("core"), "core", "left_anti").where(F.col("score") >= accept).select("core", "kind")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end), kind as an index of KINDS, for each row of docs."""
    x = written(spans_and_units(docs), "pii-spans")
    units = written(unit_rows(x), "pii-units")
    new = bootstrap(units).withColumnRenamed("kind", "as")
    added = units.where("kind is null").join(new, "core").groupBy(F.col("key").alias("_key"))
    added = added.agg(F.array_sort(F.collect_set(F.struct("start", F.col("as").alias("kind"), "end"))).alias("added"))
    x = x.join(added, F.col("key") == F.col("_key"), "left")
    none = F.slice("base", 1, 0)
    return x.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def _told(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return x.select("doc_id", *[count(k) for k in KINDS], F.sha2(_told("base"), 256).alias("base_sha256"), _told("spans").alias("spans"))


QUERIES = {"op7_pii": op7_pii}
SQL: dict[str, str] = {}
