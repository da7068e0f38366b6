"""Quality classification with hierarchical empirical Bayes.

A document's own evidence comes from a logistic regression on counts and words. Sites add
theirs: the mean quality of a host is shrunk toward the global mean, that of a path toward
its host, each by a strength estimated from how much sites differ, so a site with few
documents says little. Evidence and site posterior are added as log odds."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from travelfields.llm.text import UPPER
from travelfields.shared import write_shared

#: The classifier is fitted on at most this many labelled rows, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Words that tell good and bad rows apart best become features.
VOCABULARY = 4096
MIN_WORD_ROWS = 4
#: Site tables up to this many rows are broadcast, larger ones are joined by a shuffle.
BROADCAST_SITES = 100_000
STRENGTH = (2.0, 1e6)
SYMBOLS = "!?*#$%&|@~^<>{}[]\\/_=+"
NUMBERS = ("n_words", "upper", "digits", "symbols", "repeated_words", "repeated_lines", "word_length")


def featured(documents: DataFrame, *kept: Column) -> DataFrame:
    """kept, `words` (distinct lower-case runs of letters) and the NUMBERS of each text; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    df = documents.select(
        *kept, F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: w != "").alias("all_words"),
        share(UPPER).alias("upper"), share("0123456789").alias("digits"), share(SYMBOLS).alias("symbols"),
        F.split(text, "\n").alias("lines"), n.alias("n"),
    )
    df = df.withColumn("words", F.array_distinct("all_words"))
    size = F.greatest(F.size("all_words"), F.lit(1))
    return df.select(
        *(c for c in df.columns if c not in ("all_words", "lines", "n")),
        F.log1p(F.size("all_words")).alias("n_words"), (1 - F.size("words") / size).alias("repeated_words"),
        (1 - F.size(F.array_distinct("lines")) / F.size("lines")).alias("repeated_lines"), F.least(F.col("n") / size, F.lit(50.0)).alias("word_length"),
    )


class QualityModel:
    """Probability that a text is good. fit() needs both kinds of rows, otherwise the model is
    the constant rate of good rows (0.5 without any)."""

    def __init__(self, vocabulary: list[str], model, prior: float):
        self.vocabulary, self.model, self.prior = vocabulary, model, prior

    @staticmethod
    def _vectors(df: DataFrame, vocabulary: list[str]) -> DataFrame:
        counter = CountVectorizerModel.from_vocabulary(vocabulary, "words", "word_vector")
        counter.setBinary(True)
        return VectorAssembler(inputCols=[*NUMBERS, "word_vector"], outputCol="features").transform(counter.transform(df))

    @classmethod
    def fit(cls, documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, vocabulary: int = VOCABULARY) -> QualityModel:
        """labels: (doc_id, good). A doc_id with several labels is good only if all say so; null labels are none."""
        rated = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min(F.col("good").cast("int")).alias("good"))
        chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        rated_texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        rows = write_shared(featured(rated_texts, F.col("good")), "quality-train")
        n, good = rows.agg(F.count("*"), F.sum("good")).first()
        good = good or 0
        if not good or good == n:
            return cls([], None, (good + 0.5) / (n + 1))
        seen = rows.select("good", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum("good").alias("df_good"))
        rate = lambda a, b: (a + 0.5) / (b + 1.0)
        lift = F.abs(F.log(rate(F.col("df_good"), good) / rate(F.col("df") - F.col("df_good"), n - good))) * F.sqrt("df")
        words = [r["word"] for r in seen.where(F.col("df") >= MIN_WORD_ROWS).orderBy(lift.desc(), "word").limit(vocabulary).collect()] or ["-"]
        model = LogisticRegression(labelCol="good", regParam=1e-3, maxIter=60).fit(cls._vectors(rows, words).select("good", "features"))
        return cls(words, model, good / n)

    def score(self, documents: DataFrame, *kept: Column) -> DataFrame:
        """kept and doc_score, from 1e-6 to 1 - 1e-6."""
        if self.model is None:
            return documents.select(*kept, F.lit(self.prior).alias("doc_score"))
        df = self._vectors(featured(documents, *kept), self.vocabulary)
        out = self.model.transform(df)
        p = F.element_at(vector_to_array("probability"), 2)
        mine = [c for c in df.columns if c not in ("words", "word_vector", "features", *NUMBERS)]
        return out.select(*mine, F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p)).alias("doc_score"))


def _strength(groups: DataFrame, mean: str, n: str, center: str) -> float:
    """Pseudo-documents of the prior, by the method of moments: sites differ by sampling alone -> strong prior."""
    r = groups.where(f"{n} > 1").agg(
        F.avg(F.pow(F.col(mean) - F.col(center), 2)).alias("between"), F.avg(F.col("var") / F.col(n)).alias("noise"), F.avg(F.col(center) * (1 - F.col(center))).alias("unit")
    ).first()
    if r["between"] is None:
        return STRENGTH[0]
    extra = r["between"] - r["noise"]
    return float(min(STRENGTH[1], max(STRENGTH[0], r["unit"] / extra - 1))) if extra > 0 else STRENGTH[1]


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """scored: (host, path, doc_score). Returns (host, path, n, total, host_posterior, path_strength) by path and the global mean.

    Sums by (host, path) are combined before the shuffle, so a site with a third of all rows costs
    no more than another."""
    paths = write_shared(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("doc_score").alias("total"), F.sum(F.col("doc_score") ** 2).alias("squares")), "quality-paths"
    )
    n, total = paths.agg(F.sum("n"), F.sum("total")).first()
    mean = (total + 0.5) / (n + 1.0) if n else 0.5
    var = lambda n, t, q: F.greatest(F.lit(0.0), F.col(q) / F.col(n) - F.pow(F.col(t) / F.col(n), 2))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"), F.sum("squares").alias("host_squares")).select(
        "host", "host_n", "host_total", (F.col("host_total") / F.col("host_n")).alias("mean"), F.lit(mean).alias("center"), var("host_n", "host_total", "host_squares").alias("var")
    )
    hosts = write_shared(hosts, "quality-hosts")
    k = _strength(hosts, "mean", "host_n", "center")
    hosts = hosts.select("host", ((k * mean + F.col("host_total")) / (k + F.col("host_n"))).alias("host_posterior"))
    joined = paths.join(hosts.withColumnRenamed("host", "of_host"), F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    joined = write_shared(joined.withColumn("mean", F.col("total") / F.col("n")).withColumn("var", var("n", "total", "squares")), "quality-sites")
    k = _strength(joined, "mean", "n", "host_posterior")
    return joined.select("host", "path", "n", "total", "host_posterior", F.lit(k).alias("path_strength")), mean


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(documents: DataFrame, labels: DataFrame, host: Column, path: Column, *kept: Column, threshold: float = 0.5) -> DataFrame:
    """kept columns of each row of documents, and doc_score (its own evidence), host_posterior, path_posterior (without the
    row itself), quality (all combined) and keep (quality >= threshold).

    labels: (doc_id, good boolean or 0/1), host and path are Columns of documents. Null hosts and
    paths are sites of their own, null texts empty texts. Repeated rows are scored each. Columns of
    documents named like those returned are hidden unless kept under another name. Empty documents
    give no rows; without labels of both kinds every document has the same evidence."""
    model = QualityModel.fit(documents, labels)
    cols = [c.alias(f"_kept{i}") for i, c in enumerate(kept)]
    names = documents.select(*kept).columns
    # Written, as sites need all scores before any row is done: each text is read and scored once.
    scored = write_shared(model.score(documents, *cols, host.alias("host"), path.alias("path")), "quality-scores")
    sites, mean = site_posteriors(scored.select("host", "path", "doc_score"))
    sites = sites.withColumnsRenamed({"host": "of_host", "path": "of_path"})
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    both = scored.join(sites, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
    k = F.col("path_strength")
    own = (k * F.col("host_posterior") + F.col("total") - F.col("doc_score")) / (k + F.col("n") - 1)
    clip = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    both = both.withColumn("path_posterior", clip(own))
    odds = _logit(F.col("doc_score")) + _logit(F.col("path_posterior")) - _logit(F.lit(min(max(mean, 1e-6), 1 - 1e-6)))
    quality = 1 / (1 + F.exp(-odds))
    return both.select(
        *(F.col(f"_kept{i}").alias(n) for i, n in enumerate(names)), "doc_score", "host_posterior", "path_posterior", quality.alias("quality"), (quality >= threshold).alias("keep")
    )
