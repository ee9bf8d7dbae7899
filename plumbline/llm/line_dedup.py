"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is its words. A line of at least `min_words` words is removed if an earlier line, by (doc_id, place in
the text), has the same words or is one word edit away (a word inserted, deleted or replaced: with five words
or more, at least four in five agree). Lines are judged on the input, not on what is left. A shorter line of at
least `equal_words` words is removed if an earlier one has the same words; lines without a word stay.

1. Equal lines form classes by a 128-bit hash of their words; a class keeps its earliest line.
2. One edit leaves the first p or the last p words intact, so only classes that share such an end with another
   class can have a partner. p is the same for most neighbouring lengths; where it changes, both are used.
3. Those classes emit the hashes of their words and of their words with one left out. Of the lines that emit
   one variant by leaving out the same place, each is a replacement away from the earliest. A line that is the
   variant itself is an insertion away from each that emits it. So the earliest on either side stands for all,
   and no pairs are made within a group.
4. Each line's earliest partner is verified on the words themselves.

Nulls: a null text is one empty line; a null doc_id is earlier than all others. Rows that repeat a doc_id with
different texts follow each other by the hash of their texts. Rows that repeat both tie, and a tie removes nothing. Empty texts and tables stay as they are. Further columns pass
through, except n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import GAP, SMALL_ROWS, table, written

MIN_WORDS = 5
#: Lengths of the ends that are compared: 2, 3, 4, 6, 8, 12, ...; line lengths are below 2 ** 31.
ENDS = sorted({2 ** k for k in range(1, 30)} | {3 * 2 ** k for k in range(29)})


def _end(n: Column) -> Column:
    """The largest listed length that fits twice into n words."""
    # of 2 ** k and 3 * 2 ** (k - 1), with k the binary logarithm of n / 2
    k = F.floor(F.log2((n / 2).cast("double"))).cast("int")
    low = F.pow(F.lit(2.0), k).cast("int")
    high = (F.pow(F.lit(2.0), k - 1) * 3).cast("int")
    return F.when((k >= 1) & (2 * high <= n), high).otherwise(low)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _plain(line: Column) -> Column:
    """A line's words, joined by one space."""
    return F.trim(F.regexp_replace(line, GAP, " "))


def _ends(plain: Column, n: Column) -> Column:
    """Hashes of a line's first and last words, as many as fit twice into it, and into it less one word."""
    p, q = _end(n), _end(n - 1)
    cut = lambda k: F.call_function("substring_index", plain, F.lit(" "), k)
    pair = lambda k: F.array(F.xxhash64(F.lit(0), k, cut(k)), F.xxhash64(F.lit(1), k, cut(-k)))
    return F.when(p == q, pair(p)).otherwise(F.concat(pair(p), pair(q)))


def variants(found: DataFrame) -> DataFrame:
    """place, out, variant: each line's hash (out -1), and the hashes of its words without the one at `out`.

    A hash joins those of the words and their places by exclusive or, so one pass over a line gives them all.
    """
    word = found.select(F.struct("doc_id", "nth", "at").alias("place"), F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    word = word.select("place", "n", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("left"))
    line = W.partitionBy("place")
    so_far = line.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    before = F.bit_xor("here").over(so_far).bitwiseXOR(F.col("here"))
    after = F.bit_xor("left").over(line).bitwiseXOR(F.bit_xor("left").over(so_far))
    each = F.struct(F.col("i").alias("out"), F.xxhash64(F.col("n") - 1, before.bitwiseXOR(after)).alias("variant"))
    whole = F.struct(F.lit(-1).alias("out"), F.xxhash64(F.col("n"), F.bit_xor("here").over(line)).alias("variant"))
    out = word.select("place", "i", each.alias("each"), whole.alias("whole"))
    out = out.select("place", F.explode(F.when(F.col("i") == 0, F.array("whole", "each")).otherwise(F.array("each"))).alias("v"))
    return out.select("place", "v.out", "v.variant")


def _told_apart(docs: DataFrame) -> Callable:
    """For doc_id and text: what joins a table's rows to the doc_ids that have several texts, and the column that tells those texts apart (0 elsewhere)."""
    ids = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a != b")
    ids = written(ids.select(F.col("doc_id").alias("_several"), F.lit(True).alias("_told")), "line-ids")
    n = ids.count()
    ids = F.broadcast(ids) if n <= SMALL_ROWS else ids

    def by(doc_id: Column, text: Column) -> tuple[Callable[[DataFrame], DataFrame], Column]:
        if not n:
            return lambda df: df, F.lit(0).cast("long")
        return lambda df: df.join(ids, doc_id.eqNullSafe(F.col("_several")), "left"), F.when(F.col("_told"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))

    return by


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, equal_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, nth, at) of the lines of `docs` (doc_id, nth, text) that have an earlier line within one word edit, or an equal one if they are short.

    nth orders texts of one doc_id.
    """
    if min_words < 5:
        raise ValueError("a line one word shorter must still have two ends of two words")
    plain = F.posexplode(F.transform(_lines(F.col("text")), _plain)).alias("at", "plain")
    n = F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1
    slim = docs.select("doc_id", "nth", plain).withColumn("n", n).where((F.col("n") >= min(min_words, equal_words)) & (F.col("plain") != ""))
    h1, h2 = F.xxhash64("plain"), F.xxhash64(F.lit(7), "plain")
    # without ends a line is near to none
    ends = F.when(F.col("n") >= min_words, _ends(F.col("plain"), F.col("n"))) if equal_words < min_words else _ends(F.col("plain"), F.col("n"))
    slim = written(slim.select("doc_id", "nth", "at", h1.alias("h1"), h2.alias("h2"), ends.alias("ends")), "lines")
    place = F.struct("doc_id", "nth", "at")
    classes = written(slim.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("ends").alias("ends")), "line-classes")
    shared = classes.select("h1", F.explode("ends").alias("end"))
    busy = shared.groupBy("end").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("end")
    partners = shared.join(busy, "end", "left_semi").select("h1").distinct()
    wanted = classes.join(partners, "h1", "left_semi").select("h1", "h2", "first.doc_id", "first.nth", "first.at")
    wanted = wanted.groupBy("doc_id", "nth").agg(F.array_sort(F.collect_set(F.struct("at", F.struct("h1", "h2").alias("id")))).alias("wanted"))
    found = docs.select(F.col("doc_id").alias("_id"), F.col("nth").alias("_nth"), "text").join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_nth") == F.col("nth"))).select("doc_id", "nth", "text", "wanted")
    before = F.concat(F.array(F.lit(-1)), F.slice(F.col("wanted")["at"], 1, F.size("wanted") - 1))
    nothing = F.slice("wanted", 1, 0)
    beside = F.flatten(F.zip_with("wanted", before, lambda x, p: F.concat(F.array_repeat(F.try_element_at(nothing, F.lit(1)), x["at"] - p - 1), F.array(x))))
    beside = F.zip_with(_lines(F.col("text")), beside, lambda line, x: F.when(x.isNotNull(), F.struct(x.alias("x"), line.alias("line"))))
    found = found.select("doc_id", "nth", F.explode(F.filter(beside, lambda x: x.isNotNull())).alias("y"))
    found = found.select("doc_id", "nth", "y.x.at", "y.x.id", F.split(_plain(F.col("y.line")), " ").alias("words")).dropDuplicates(["doc_id", "nth", "at"])
    found = written(found, "line-partners")

    emitted = written(variants(found), "line-variants")
    seen = emitted.groupBy("variant", "out").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    is_whole = F.col("out") < 0
    busy = seen.groupBy("variant").agg(
        F.min(F.when(is_whole, F.col("low"))).alias("short"), F.min(F.when(~is_whole, F.col("low"))).alias("long"), F.max(~is_whole & (F.col("low") < F.col("high"))).alias("replaced")
    )
    busy = written(busy.where("replaced or (short is not null and long is not null)"), "line-busy")
    emitted = written(emitted.join(busy.select("variant"), "variant", "left_semi"), "line-busy-variants")
    replaced = emitted.where(~is_whole).groupBy("variant", "out").agg(F.min("place").alias("earlier"))
    found_pairs = (
        emitted.join(replaced, ["variant", "out"]).where("earlier < place").select("place", "earlier")
        .union(busy.where("long < short").select(F.col("short").alias("place"), F.col("long").alias("earlier")))
        .union(emitted.where(~is_whole).join(busy, "variant").where("short < place").select("place", F.col("short").alias("earlier")))
    )
    pairs = found_pairs.groupBy("place").agg(F.min("earlier").alias("earlier"))
    text = found.select(place.alias("is"), F.col("words").alias("of"), "id")
    pairs = pairs.join(text, F.col("place") == F.col("is")).select("id", "earlier", F.col("of").alias("mine"))
    pairs = pairs.join(text.drop("id"), F.col("earlier") == F.col("is")).select("id", "mine", F.col("of").alias("other"))
    near = written(pairs.where(one_edit(F.col("mine"), F.col("other"))).select("id.h1", "id.h2"), "line-near")
    again = classes.where("first < last").select("h1", "h2", "first")
    gone_again = slim.join(again, ["h1", "h2"]).where(F.col("first") < place).select("doc_id", "nth", "at")
    gone_near = classes.join(near, ["h1", "h2"], "left_semi").select("first.doc_id", "first.nth", "first.at")
    return gone_again.union(gone_near)


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are equal up to one word inserted, deleted or replaced."""
    least = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: x == y)
    p = F.coalesce(F.array_position(same, F.lit(False)) - 1, F.lit(0)).cast("int")
    p = F.when(p < 0, least).otherwise(p)  # no difference before the shorter one ends
    tail = lambda x, skip: F.slice(x, p + skip + 1, F.size(x))
    return (
        F.when(F.size(a) == F.size(b), tail(a, 1) == tail(b, 1))
        .when(F.size(a) == F.size(b) + 1, tail(a, 1) == tail(b, 0))
        .when(F.size(b) == F.size(a) + 1, tail(a, 0) == tail(b, 1))
        .otherwise(False)
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, equal_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` rid of the lines that removed_lines() names, and n_lines, n_removed."""
    by = _told_apart(docs.select("doc_id", "text"))
    beside, nth = by(F.col("doc_id"), F.col("text"))
    gone = removed_lines(beside(docs.select("doc_id", "text")).select("doc_id", nth.alias("nth"), "text"), min_words, equal_words)
    gone = gone.groupBy("doc_id", "nth").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    beside, nth = by(F.col("row.doc_id"), F.col("row.text"))
    row = beside(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))).select("row", nth.alias("_nth"))
    joined = row.join(gone, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_nth") == F.col("nth")), "left")
    lines = _lines(F.col("row.text"))
    joined = joined.select("row", F.size(lines).alias("n"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # a flag for each line, from the gaps between removed places
    before = F.concat(F.array(F.lit(-1)), "gone")
    flags = F.flatten(F.zip_with(before, F.concat("gone", F.array("n")), lambda p, x: F.concat(F.array_repeat(F.lit(True), x - p - 1), F.array(F.lit(False)))))
    kept = F.filter(F.zip_with(lines, flags, lambda line, keep: F.when(keep, line)), lambda x: x.isNotNull())
    text = F.when(F.size("gone") == 0, F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.col("n").alias("n_lines"), F.size("gone").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: lines, lines removed, and the SHA-256 of what is left."""
    x = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
SQL = {
    "op10_line_dedup": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
 w AS (SELECT doc_id, pos, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
 e AS (SELECT doc_id * 1000000 + pos AS o, array_to_string(w, ' ') AS k, len(w) AS n, w FROM w WHERE len(w) >= 5),
 c AS (SELECT k, min(o) AS o, min(n) AS n FROM e GROUP BY k),
 p AS (SELECT k, o, n, unnest(range(1, n + 1)) AS j FROM c),
 v AS (SELECT k, o, n, j, array_to_string(list_concat(list_slice(string_split(k, ' '), 1, j - 1), list_slice(string_split(k, ' '), j + 1, n)), ' ') AS v FROM p),
 s AS (SELECT v, j, min(o) AS o FROM v GROUP BY v, j),
 near AS (SELECT v.o FROM v JOIN s USING (v, j) WHERE s.o < v.o
  UNION SELECT v.o FROM v JOIN c ON c.k = v.v WHERE c.o < v.o
  UNION SELECT c.o FROM v JOIN c ON c.k = v.v WHERE v.o < c.o),
 gone AS (SELECT e.o FROM e JOIN c USING (k) WHERE c.o < e.o UNION SELECT o FROM near),
 z AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.o) AS n_removed, string_agg(CASE WHEN gone.o IS NULL THEN line END, chr(10) ORDER BY pos) AS kept FROM l LEFT JOIN gone ON gone.o = l.doc_id * 1000000 + l.pos GROUP BY l.doc_id)
 SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM z"""
}
