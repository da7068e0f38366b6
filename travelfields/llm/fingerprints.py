"""Canonical exact digests of documents.

The canonical text (compatibility composition, full case folding, white space folded) gets
two independently seeded 64-bit xxhashes. Rows whose 128 bits agree form a bucket, and the
texts in a bucket are compared byte by byte before they may share a fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from travelfields.operators.indexing import dense_index
from travelfields.shared import small, write_shared

#: A table up to this many rows of three longs (about 24 MB) is broadcast, a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding can undo composition), then each run of
    Unicode white space one space and none at the ends. A null text is empty. All of it runs in
    the JVM through the Unicode library that Spark ships with."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    raw = F.coalesce(text, F.lit(""))
    # Printable ASCII is its own composition and folds as lower() does.
    plain = F.when(raw.rlike("^[\\x00-\\x7f]*$"), F.lower(raw)).otherwise(nfkc(fold(nfkc(raw))))
    return F.trim(F.regexp_replace(plain, "[\\s\\p{Z}\\x85\\x1c-\\x1f]+", " "))


def wide_hash(text: Column) -> Column:
    """128 bits as struct<h1, h2>; the second hash starts from another state than the first."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), F.length(text), text).alias("h2"))


def _hex(wide: Column) -> Column:
    pad = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(pad(wide["h1"]), pad(wide["h2"]))


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with the texts of their documents; rows is a written table. Rows few enough
    go to the texts, otherwise both are shuffled."""
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    return texts.join(rows, "doc_id")


def collision_ranks(hashed: DataFrame, texts: DataFrame) -> DataFrame:
    """Byte comparison inside equal buckets.

    hashed: a written table (doc_id, part, wide); texts: (doc_id, part, canon). Returns (wide, canon,
    rank) for the texts of buckets that hold different texts: 0 for the least by bytes, and so
    on. Without collisions it is empty. Only texts of buckets with two or more rows are moved,
    and equal texts of a bucket are combined before they are."""
    shared = write_shared(hashed.groupBy("wide").agg(F.count("*").alias("n")).where("n > 1").select("wide"), "fp-buckets")
    members = write_shared(hashed.join(shared, "wide").select("doc_id", "part", "wide"), "fp-members")
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    compared = texts.join(members, ["doc_id", "part"]).groupBy("wide").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    clashing = write_shared(compared.where("lo <> hi").select("wide"), "fp-clashing")
    if clashing.isEmpty():
        return texts.limit(0).select(wide_hash(F.col("canon")).alias("wide"), "canon", F.lit(0).alias("rank"))
    rows = hashed.join(clashing, "wide").select("doc_id", "part", "wide")
    distinct = texts.join(rows, ["doc_id", "part"]).select("wide", "canon").distinct()
    return distinct.withColumn("rank", F.row_number().over(W.partitionBy("wide").orderBy("canon")) - 1)


def fingerprint(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row of documents.

    The fingerprint is 32 hex digits, followed by `-k` for the k-th different text (k >= 1, by bytes)
    of a bucket that holds several. Texts with equal canonical forms have equal fingerprints;
    a null text is the empty one. Repeated rows are repeated in the result; a null doc_id keeps its
    row. Columns but doc_id and text are ignored. Empty input: no rows."""
    canon = documents.select("doc_id", F.lit(0).alias("part"), canonical(F.col("text")).alias("canon"))
    hashed = write_shared(canon.select("doc_id", "part", wide_hash(F.col("canon")).alias("wide")), "fp-hashes")
    ranks = collision_ranks(hashed, canon)
    return _named(hashed, canon, ranks).select("doc_id", "fingerprint")


def _named(hashed: DataFrame, texts: DataFrame, ranks: DataFrame) -> DataFrame:
    plain = hashed.withColumn("fingerprint", _hex(F.col("wide")))
    ranks = write_shared(ranks, "fp-ranks")
    if ranks.isEmpty():
        return plain
    which = texts.withColumn("wide", wide_hash(F.col("canon"))).join(ranks, ["wide", "canon"]).select("doc_id", "part", "rank").distinct()
    tail = F.when(F.col("rank") > 0, F.concat(F.lit("-"), F.col("rank").cast("string"))).otherwise("")
    return plain.join(which, ["doc_id", "part"], "left").withColumn("fingerprint", F.concat("fingerprint", F.coalesce(tail, F.lit(""))))


def neighbours(ids: DataFrame, label: str = "fp-order") -> DataFrame:
    """(doc_id, next_id) along descending doc_id, the last followed by the first.

    ids: doc_id and n, distinct ids. The order is cut in ranges, each range looks at its own ids,
    and only the head of each range is looked at across ranges. Also returns next_n and, for
    each doc_id as the follower, before_id and before_n."""
    spark = ids.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = write_shared(ids.repartitionByRange(ranges, F.desc("doc_id")).withColumn("cell", F.spark_partition_id()), label)
    ends = cut.groupBy("cell").agg(F.max(F.struct("doc_id", "n")).alias("first"), F.min(F.struct("doc_id", "n")).alias("last"))
    line = W.partitionBy(F.lit(0)).orderBy("cell")  # one row for each range
    around = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select(
        "cell",
        F.coalesce(F.lead("first").over(line), F.first("first").over(around)).alias("after"),
        F.coalesce(F.lag("last").over(line), F.last("last").over(around)).alias("before"),
    )
    own = W.partitionBy("cell").orderBy(F.desc("doc_id"))
    inner = cut.select(
        "doc_id", "n", "cell",
        F.lead(F.struct("doc_id", "n")).over(own).alias("after_in"),
        F.lag(F.struct("doc_id", "n")).over(own).alias("before_in"),
    )
    return inner.join(F.broadcast(ends), "cell").select(
        "doc_id", "n",
        F.coalesce("after_in", "after")["doc_id"].alias("next_id"),
        F.coalesce("before_in", "before")["doc_id"].alias("before_id"),
        F.coalesce("before_in", "before")["n"].alias("before_n"),
    )


def fingerprint_with_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of an edited form of each.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all)
    of the next document in descending doc_id, after the last the first; a lone document follows
    itself. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next: 1.0 where the fingerprints are equal, else 0.0. Null texts are empty. Rows that
    repeat a doc_id are documents each, in the order of a hash of their texts; rows with a null doc_id come last. Columns but
    doc_id and text are ignored. Empty input: no rows."""
    docs = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows"))
    ids = write_shared(ids, "fp-ids")
    named_ids = None
    if not ids.where("rows > 1 or doc_id is null").isEmpty():
        # Where ids don't tell rows apart, each gets its place in the order as a name.
        docs = write_shared(docs.withColumn("row", F.monotonically_increasing_id()), "fp-docs")
        key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64("text"), "row")
        named_ids = write_shared(dense_index(docs.select("row", F.col("doc_id").alias("own_id"), F.length("text").alias("n"), key.alias("key")), "key", "doc_id").drop("key"), "fp-names")
        docs = docs.drop("doc_id").join(small(named_ids.select("row", "doc_id")), "row").select("doc_id", "text")
        ids = named_ids.select("doc_id", "n")
    order = write_shared(neighbours(ids.select("doc_id", "n")), "fp-next")
    held = docs.join(order, "doc_id")
    lent = held.select(F.col("before_id").alias("doc_id"), F.expr("substring(text, 1, cast(floor(before_n / 2) as int))").alias("lent"))
    edited = F.expr("concat(substring(text, 1, n - cast(floor(n / 2) as int)), lent)")
    both = (
        held.select("doc_id", "text", "n", "next_id").join(lent, "doc_id")
        .select("doc_id", "n", "next_id", canonical(F.col("text")).alias("canon"), edited.alias("edited"))
        .withColumn("edited_canon", canonical(F.col("edited")))
    )
    work = write_shared(
        both.select(
            "doc_id", F.col("n").cast("long").alias("n_chars"), "next_id",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            wide_hash(F.col("canon")).alias("wide"), wide_hash(F.col("edited_canon")).alias("edited_wide"), "edited_canon",
        ),
        "fp-work",
    )
    hashed = write_shared(
        work.select("doc_id", F.lit(0).alias("part"), "wide").unionByName(work.select("doc_id", F.lit(1).alias("part"), F.col("edited_wide").alias("wide"))),
        "fp-hashes",
    )
    texts = docs.select("doc_id", F.lit(0).alias("part"), canonical(F.col("text")).alias("canon")).unionByName(
        work.select("doc_id", F.lit(1).alias("part"), F.col("edited_canon").alias("canon"))
    )
    ranks = collision_ranks(hashed, texts)
    named = _named(hashed, texts, ranks).select("doc_id", "part", "fingerprint")
    name = named.where("part = 0").select("doc_id", "fingerprint")
    edit = named.where("part = 1").select("doc_id", F.col("fingerprint").alias("edited_fingerprint"))
    nxt = name.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("next_fingerprint"))
    same = lambda a: (F.col("fingerprint") == F.col(a)).cast("double")
    out = (
        work.select("doc_id", "n_chars", "next_id", "edited_sha256").join(name, "doc_id").join(edit, "doc_id").join(nxt, "next_id")
        .select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"),
        )
    )
    if named_ids is None:
        return out
    return out.join(small(named_ids.select("doc_id", "own_id")), "doc_id").withColumn("doc_id", F.col("own_id")).drop("own_id")
