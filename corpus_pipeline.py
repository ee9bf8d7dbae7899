"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return
the columns of documents; what is written between stages is read again as the next one's docs.

1. toxicity: documents that the classifier rejects go.
2. line_dedup: lines that repeat earlier ones, or nearly do (from five words on), leave the texts; n_chars follows.
3. near_duplicates: documents link at a Jaccard similarity of 0.8 or more of their five-word shingles,
   counted as often as they occur, found by SimHash with multi-index hashing and by MinHash bands; one document of each component stays, the one with the smallest
   doc_id; a null doc_id comes last, and of equal doc_ids the smallest hash of the text comes first.
4. mixing: sources are taken to their target weights; a document taken several times is several rows.
5. packing: pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, mixing, packing, simhash, toxicity
from plumbline.plans.shared import ship, written

#: SQL has no tokenizer, XXH64 or fitted classifier, so the stages are tested against brute-force versions.
ORACLE_SQL = None
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored like others; repeated rows get equal scores; without usable labels the seed lexicons decide."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mined, weights = toxicity.fit(docs, labels)
    return toxicity.kept(docs, mined, weights)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null. Of rows that repeat a doc_id and a text none is the earlier one, and a line without words always stays."""
    out = line_dedup.dedup_lines(docs, equal_words=1)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return out.select(*[F.coalesce(F.length("text"), F.lit(0)).cast(kind).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component; texts without words are copies of each other; rows without a doc_id are judged by their texts."""
    found = simhash.near_copies(docs, SHINGLE)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h1", "h2")
    stay = found.groupBy("root").agg(F.min(first).alias("first")).select("first.id", F.col("first.h1").alias("_h1"), F.col("first.h2").alias("_h2"))
    h1, h2 = simhash.text_hashes()
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("of"), h1, h2)
    marked = marked.join(stay, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & F.col("of").eqNullSafe(F.col("id")))
    return marked.dropDuplicates(["of", "h1", "h2"]).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. Nulls, ties and repeated rows: as mixing.mix() has them; an empty table stays empty."""
    return mixing.mixed(docs, [5.0, 2.0, 1.0])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts are empty; repeated rows stay separate; an empty table gives no pieces."""
    import public_tokenizers

    # workers hold what earlier stages left in memory too, so few words are kept
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, cache_words=150_000)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
