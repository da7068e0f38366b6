"""A training corpus from raw documents: classify, drop near copies, remove repeated passages, mix sources, pack.

STAGES are applied in order. Each takes (spark, docs, sf_dir), and its result is written and read again as the
next one's docs; all but the last return the columns of documents. A stage decides on hashes of rows and then applies
what it decided to the rows, so texts are not moved while the decision is made. Rows that repeat one another in all
columns have one hash and are told apart by their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from travelfields.llm import mixing, ngram_join, packing, quality, suffix_dedup
from travelfields.llm.queries import PACK_TOKENIZER, good_labels, n_words, tokenizer_path
from travelfields.llm.text import row_hash
from travelfields.shared import drop_shared, scratch, small, write_shared


def _row(docs: DataFrame) -> list:
    return row_hash(*(F.col(c) for c in docs.columns))


def _with_copies(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs with some rows more or less often. decided is a written table (h1, h2, n, t): that the n rows of this hash are to
    be t rows. Rows of other hashes stay as they are."""
    both = docs.select(F.struct(*docs.columns).alias("document"), *_row(docs)).join(small(decided), ["h1", "h2"], "left")
    out = both.where("n is null or n = 1").select("document", F.coalesce("t", F.lit(1)).cast("int").alias("t"))
    if not decided.where("n > 1").isEmpty():
        alike = both.where("n > 1").groupBy("h1", "h2").agg(F.first("document").alias("document"), F.first("t").cast("int").alias("t"))
        out = out.unionByName(alike.select("document", "t"))
    return out.where("t > 0").withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("t")))).select("document.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, as they are.

    Null and empty texts are judged as empty texts, very long ones whole. Rows that repeat one another are judged alike, and
    a document at the threshold stays. Columns named like the classifier's own are kept. No rows: none."""
    with scratch():
        labels = good_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
        judged = quality.classify(docs, labels, F.col("source"), F.col("lang"), *_row(docs)).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.count_if("keep").alias("t"))
        rejected = write_shared(judged.where("t < n"), "pipeline-rejected", keep=True)
    return _with_copies(docs, rejected)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, null ids last.

    Rows that repeat a doc_id or one another are rows like any other, so of copies exactly one row stays. Rows without a word (null, empty
    or blank texts) have no copies and stay all. Texts are compared whole. Extra columns stay. No rows: none."""
    with scratch():
        rows = ngram_join.jaccard_rows(docs, identity=tuple(F.col(c) for c in docs.columns))
        kept = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.count_if("is_first").alias("t"))
        fewer = write_shared(kept.where("t < n"), "pipeline-copies", keep=True)
    return _with_copies(docs, fewer)


def _one_of_equal_texts(docs: DataFrame) -> DataFrame:
    """docs with one row, that of the smallest doc_id, of those with the same text of at least LENGTH bytes."""
    t1, t2 = row_hash(F.col("text"))
    rows = docs.where(F.octet_length("text") >= suffix_dedup.LENGTH).select("doc_id", *_row(docs), t1.alias("t1"), t2.alias("t2"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2"))
    with scratch():
        equal = write_shared(rows.groupBy("t1", "t2").agg(F.count("*").alias("k"), first.alias("f")).where("k > 1").select("t1", "t2", "f"), "pipeline-equal")
        own = (F.col("h1") == F.col("f.h1")) & (F.col("h2") == F.col("f.h2"))
        of = rows.join(small(equal), ["t1", "t2"]).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(own.cast("int")).alias("t")).where("t < n")
        fewer = write_shared(of, "pipeline-equal-rows", keep=True)
    return docs if fewer.isEmpty() else _with_copies(docs, fewer)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 200 bytes or more that occur twice.

    Of rows with one text of that length one stays, as its repeats would otherwise erase it; passages are judged on the rows that then
    are left. A character that a cut splits goes; so do documents of which nothing is left but white space, if something
    was removed. n_chars is counted anew. Null and empty texts and extra columns stay, long texts are judged whole. No rows: none."""
    docs = _one_of_equal_texts(docs)
    whole = F.struct(*docs.columns).alias("document")
    out = suffix_dedup.remove_repeats(docs, suffix_dedup.LENGTH, whole)
    # Bytes of a split character become U+FFFD, which goes.
    text = F.when(F.col("n_removed") == 0, F.col("document.text")).otherwise(F.replace(F.make_valid_utf8(F.col("left").cast("string")), F.lit("�"), F.lit("")))
    out = out.withColumn("document", F.col("document").withField("text", text))
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("document.text", "\\s+", " ")) != "")).select("document.*")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target has it.

    Texts without a word (null, empty or blank) have nothing to give and go. A null source is a source, the last. Rows that
    repeat one another are rounded each on its own, and their copies are added up. Ties of size are broken by a hash of
    the row. Extra columns stay. No rows: none."""
    with scratch():
        h1, h2 = _row(docs)
        mixed = mixing.mix(docs.select(F.struct(h1, h2).alias("doc_id"), "source", "text"), n_words())
        copies = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("copies").alias("t")).where("t <> n").select("doc_id.*", "n", "t")
        copies = write_shared(copies, "pipeline-mix", keep=True)
    return _with_copies(docs, copies)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 4096 tokens.

    Null and empty texts are one token, the end; long ones are cut into pieces. Repeated rows are packed each, a null doc_id stays
    null. Of other columns none is read. No rows: none."""
    return packing.pack(docs, tokenizer_path(PACK_TOKENIZER))


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", remove_repeated_passages),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted models, Newton steps and tokenizers have no SQL; tests check what each stage keeps, on the smallest tables and on awkward rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's tables and its input are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch():
            docs = write_shared(stage(spark, before, sf_dir), "pipeline-" + name.split()[0], keep=True)
        drop_shared(before)
    return STAGES[-1][1](spark, docs, sf_dir)
