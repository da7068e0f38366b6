"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and max_copies: the rates closest in relative entropy to one
another's equal start that give each source its target of words. Their form is
max_copies / (1 + exp(-lambda * size)), an exponential tilt by size that cannot pass the
bound, and the lambdas solve a convex dual by Newton steps. Rates become copies by systematic
rounding along sizes, which keeps each source's words near its target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from travelfields.operators.indexing import dense_index
from travelfields.shared import drop_shared, scratch, write_shared

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
STEPS = 40
TOLERANCE = 1e-7
#: Documents of one source and size that are ranked together; a larger cell is split by a hash.
CELL_ROWS = 256
#: Rates are whole multiples of 1 / UNIT from the solution on, so sums don't depend on their order.
UNIT = 1 << 24


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """sizes: (source, source_size), one row for each source. Adds weight and target.

    Sources in code point order, null last, take the weights in turn. The budget, share of all
    words, is divided by weight; a target stops at cap times the source's size, and what is over
    is shared by weight among the others until none is above. If share > cap all stop there."""
    named = sizes.where("source is not null")
    ranked = dense_index(named, "source", "rank")
    rest = sizes.where("source is null").crossJoin(F.broadcast(named.agg(F.count("*").alias("rank"))))
    ranked = ranked.unionByName(rest.select(*ranked.columns))
    ws = F.array(*(F.lit(float(w)) for w in weights))
    table = write_shared(
        ranked.withColumn("weight", F.element_at(ws, (F.col("rank") % len(weights)).cast("int") + 1)).withColumn("most", F.col("source_size") * float(cap)), "mix-sources"
    )
    budget = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, -1
    while True:  # each pass stops at least one more source, or ends
        full = F.col("most") <= F.col("weight") * level
        row = table.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(full).alias("n"),
        ).first()
        if not row["open"] or row["n"] == before:
            level = level if row["open"] else float("inf")
            break
        before, level = row["n"], max(0.0, budget - row["fixed"]) / row["open"]
    target = F.least(F.col("most"), F.col("weight") * level) if level != float("inf") else F.col("most")
    return table.withColumn("target", target.cast("double")).drop("most", "rank")


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return cap / (1 + F.exp(-lam * x))


def balance(cells: DataFrame, targets: DataFrame, cap: float = MAX_COPIES, steps: int = STEPS) -> DataFrame:
    """(source_key, lam, mean): the dual's solution for each source.

    cells: written (source_key, size, n), documents counted by size; targets: (source_key,
    source_size, target). lam tilts by size / mean. Each step sums first and second derivatives of
    the dual over all cells with map-side combine. Newton steps are kept inside a bracket that
    only narrows, so the solution is found from any start. A source whose target is its
    bound gets an infinite lam."""
    x = F.col("size") / F.col("mean")
    state = write_shared(
        cells.where("size > 0").groupBy("source_key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
        .join(targets, "source_key")
        .select(
            "source_key", "mean", "target", "source_size",
            F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("lam"),
            F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"),
            (F.col("target") >= cap * F.col("source_size")).alias("done"),
        ), "mix-state",
    )
    for _ in range(steps):
        if state.where("not done").isEmpty():
            break
        rate = _rate(F.col("lam"), x, cap)
        slope = rate * (1 - rate / cap) * F.col("size") * x
        sums = cells.where("size > 0").join(state.where("not done").select("source_key", "lam", "mean"), "source_key").groupBy("source_key").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * slope).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        middle = (lo + hi) / 2
        step = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise(middle)
        near = F.abs(gap) <= TOLERANCE * F.col("source_size")
        nxt = write_shared(
            state.join(sums, "source_key", "left").select(
                "source_key", "mean", "target", "source_size",
                F.when(F.col("done") | near, F.col("lam")).otherwise(step).alias("lam"),
                F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"),
                (F.col("done") | near).alias("done"),
            ), "mix-state",
        )
        drop_shared(state)
        state = nxt
    if not state.where("not done").isEmpty():
        raise RuntimeError("entropy balancing did not settle")
    return state.select("source_key", "lam", "mean")


def mix(documents: DataFrame, size: Column, weights=WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of documents.

    size is a long expression over documents, read once. copies is 0 to cap. Documents of size 0
    (null or blank texts) take part with copies 0: they have no words to give. A null source
    is a source, the last. Repeated rows are rounded each on its own and so may differ by
    one copy. The same rows give the same copies, whatever their order or partitions, except that
    of identical rows (doc_id, source and size) it is open which gets the extra copy. A null doc_id
    keeps its row. Ties of size are broken by a hash of doc_id. However long a text is, only its size counts. Other columns are
    ignored. Empty input: no rows."""
    with scratch():
        return write_shared(_copies(documents, size, weights, share, cap), "mix-copies", keep=True)


def _copies(documents: DataFrame, size: Column, weights, share: float, cap: int) -> DataFrame:
    base = write_shared(
        documents.select("doc_id", "source", F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
        .withColumn("source_key", F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")))), "mix-docs",
    )
    cells = write_shared(base.groupBy("source_key", "source", "size").agg(F.count("*").alias("n")), "mix-cells")
    sizes = cells.groupBy("source_key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = write_shared(source_targets(sizes, weights, share, cap), "mix-targets")
    duals = balance(cells, targets, cap)

    solved = cells.where("size > 0").join(duals, "source_key")
    x = F.col("size") / F.col("mean")
    unit = F.when(F.col("lam") == float("inf"), F.lit(cap * UNIT)).otherwise(F.round(_rate(F.col("lam"), x, cap) * UNIT)).cast("long")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL_ROWS)).cast("long")
    solved = write_shared(solved.select("source_key", "size", unit.alias("unit"), pieces.alias("pieces")), "mix-rates")

    lot = F.xxhash64("doc_id", F.lit("lot"))
    dealt = write_shared(
        base.where("size > 0").join(solved, ["source_key", "size"])
        .select("doc_id", "source_key", "size", "unit", F.pmod(lot, F.col("pieces")).alias("piece"), lot.alias("lot")), "mix-dealt",
    )
    # Along sizes, within bands of a factor of two, each piece starts where the one before ended.
    band = F.floor(F.log2("size")).cast("int")
    line = W.partitionBy("source_key", "band").orderBy("size", "piece").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("source_key", "size", "piece").agg((F.count("*") * F.first("unit")).alias("given")).withColumn("band", band)
        .withColumn("start", F.pmod(F.xxhash64("source_key", "band", F.lit("start")), F.lit(UNIT)) + F.coalesce(F.sum("given").over(line), F.lit(0)))
        .select("source_key", "size", "piece", "start")
    )
    starts = write_shared(starts, "mix-starts")
    within = W.partitionBy("source_key", "size", "piece").orderBy("lot", "doc_id")
    at = F.col("start") + F.col("unit") * F.col("k")
    copies = (
        dealt.withColumn("k", F.row_number().over(within).cast("long")).join(starts, ["source_key", "size", "piece"])
        .select("doc_id", "source_key", "size", (F.floor(at / UNIT) - F.floor((at - F.col("unit")) / UNIT)).cast("long").alias("copies"))
    )
    rows = copies.unionByName(base.where("size = 0").select("doc_id", "source_key", "size", F.lit(0).cast("long").alias("copies")))
    return rows.join(targets.select("source_key", "source", "source_size", "target"), "source_key").select("doc_id", "source", "size", "source_size", "target", "copies")
