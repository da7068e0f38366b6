"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits recursively near the median along a random direction; vectors near the
cut go to both sides (spill), in a band as wide as linked vectors are apart. A node whose
band holds much of a label isn't split for that label, so dense groups stay whole. Vectors
are compared only inside leaves, so a pair is found if any tree keeps it together, and
every comparison is exact. The forest is fitted on a bounded sample; every vector is put
into all of its leaves."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from travelfields.operators.components import connected_components
from travelfields.shared import write_shared

THRESHOLD = 0.93
TREES = 8
LEAF_ROWS = 256
#: Width of the band that spills to both sides, in standard deviations of the distance of a pair at the threshold.
SPILL = 1.0
#: A node is split for a label only if that leaves at most this share of its comparisons.
GAIN = 0.8
CUTS = (0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65)
#: Rows of a label that the sample must have in all, and in a node, to judge splits by.
LABEL_SAMPLE, NODE_SAMPLE = 64, 16
#: The forest is fitted on at most this many vectors and has at most sample / 64 leaves a tree.
SAMPLE_ROWS = 32_768
#: Leaves above this are compared in tiles, each pair of tiles in a task of its own.
TILE_ROWS = 1024
#: Leaf tables up to this many rows are broadcast, larger ones are joined by a shuffle.
BROADCAST_LEAVES = 500_000


class Forest:
    """Directions and spill bounds of complete binary trees, heap order, and the nodes at which a label stays whole.

    A direction of normal numbers moves two vectors of cosine threshold apart by sqrt(2 - 2 threshold) as standard
    deviation, so a band that wide keeps most linked pairs together at each node however dense the data is."""

    def __init__(self, sample: np.ndarray, label: np.ndarray, scale: float, depth: int, trees: int = TREES, threshold: float = THRESHOLD, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim, self.depth, self.trees = sample.shape[1], depth, trees
        inner, half = (1 << depth) - 1, SPILL * math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
        self.direction = rng.standard_normal((trees, inner, self.dim)).astype(np.float32)
        self.low, self.high = np.full((trees, inner), -half, np.float32), np.full((trees, inner), half, np.float32)
        names, n = np.unique(label, return_counts=True)
        self.names = names[n >= LABEL_SAMPLE]
        code, n_labels = self._code(label), len(self.names) + 1
        # The last column is for labels with too few rows in the sample: those are split everywhere.
        self.whole = np.zeros((trees, inner, n_labels), bool)
        pairs = np.zeros(n_labels)
        for t in range(trees):
            rows = {0: np.arange(len(sample))}
            for node in range(inner):
                r = rows.pop(node, np.zeros(0, int))
                if len(r):
                    p = sample[r] @ self.direction[t, node]
                    # Of the cuts near the median, the one whose band holds least.
                    cut, s = np.quantile(p, CUTS), np.sort(p)
                    held = np.searchsorted(s, cut + half, "right") - np.searchsorted(s, cut - half)
                    c = cut[np.lexsort((np.abs(np.array(CUTS) - 0.5), held))[0]]
                    self.low[t, node], self.high[t, node] = c - half, c + half
                    left, right = p <= self.high[t, node], p >= self.low[t, node]
                    a, b, both = (np.bincount(code[r[k]], minlength=n_labels).astype(float) for k in (left, right, slice(None)))
                    w = (both * scale <= LEAF_ROWS) | (both >= NODE_SAMPLE) & (a * a + b * b > GAIN * both * both)
                    w[-1] = False
                    self.whole[t, node] = w
                    pairs += np.where(w, both * (both - 1), 0)
                    go = ~w[code[r]]
                    rows[2 * node + 1], rows[2 * node + 2] = r[left & go], r[right & go]
            for r in rows.values():
                both = np.bincount(code[r], minlength=n_labels).astype(float)
                pairs += both * (both - 1)
        # Labels that all trees together compare no less often than one leaf would: one leaf, which loses nothing.
        n = np.bincount(code, minlength=n_labels).astype(float)
        self.single = (pairs >= n * (n - 1)) | (depth == 0)
        self.single[-1] = depth == 0

    def _code(self, label: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(label), np.int64)
        at = np.searchsorted(self.names, label).clip(0, len(self.names) - 1)
        return np.where(self.names[at] == label, at, len(self.names))

    def leaves(self, x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all rows; leaf numbers are unique over trees, ordered by row and leaf."""
        code = self._code(label)
        single = self.single[code]
        out = [(np.flatnonzero(single), np.zeros(single.sum(), np.int64))]
        for t in range(self.trees):
            row = np.flatnonzero(~single)
            node = np.zeros(len(row), np.int64)
            for _ in range(self.depth):
                stay = self.whole[t, node, code[row]]
                out.append((row[stay], node[stay] + t * (2 << self.depth)))
                row, node = row[~stay], node[~stay]
                p = np.einsum("ij,ij->i", x[row], self.direction[t, node])
                left, right = p <= self.high[t, node], p >= self.low[t, node]
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            out.append((row, node + t * (2 << self.depth)))
        row, leaf = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows cut or padded with zeros to dim, of length one."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == dim).all():
        x = flat.reshape(len(n), dim).astype(np.float64)
    else:
        x = np.zeros((len(n), dim))
        for k, v in enumerate(np.split(flat, np.cumsum(n)[:-1])):
            x[k, : min(dim, len(v))] = v[:dim]
    # Scale first, so that squares of very large or small numbers stay finite.
    x /= np.maximum(np.abs(x).max(1, initial=0.0), 1e-300)[:, None]
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


_ROW = "vec_id long, m long, label int, dim int, leaf long, leaves array<long>, v array<double>"


def _assign(forest, with_vector: bool):
    def run(batches):
        f: Forest = forest.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                x = _matrix(b.column("v"), f.dim).astype(np.float32)
                row, leaf = f.leaves(x, b.column("label").to_numpy())
                if not with_vector:
                    yield pa.RecordBatch.from_arrays([b.column("label").take(pa.array(row)), b.column("dim").take(pa.array(row)), pa.array(leaf)], ["label", "dim", "leaf"])
                    continue
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(x)))))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(leaf))
                t = b.append_column("leaves", lists).take(pa.array(row)) if hasattr(b, "append_column") else None
                yield pa.RecordBatch.from_arrays(
                    [t.column("vec_id"), t.column("m"), t.column("label"), t.column("dim"), pa.array(leaf), t.column("leaves"), t.column("v")],
                    ["vec_id", "m", "label", "dim", "leaf", "leaves", "v"],
                )

    return run


def _earlier(lists, leaf: int) -> np.ndarray:
    """0/1 rows: which of the leaves before this one a vector is in."""
    values = [np.array([v for v in row if v < leaf]) for row in lists]
    flat = np.concatenate(values) if values else np.zeros(0)
    names, at = np.unique(flat, return_inverse=True)
    out = np.zeros((len(values), max(1, len(names))), np.float32)
    out[np.repeat(np.arange(len(values)), [len(v) for v in values]), at] = 1
    return out


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, m = table.column("vec_id").to_numpy(), table.column("m").to_numpy().astype(np.float64)
        x = _matrix(table.column("v"), table.column("dim")[0].as_py())
        seen = _earlier(table.column("leaves").to_pylist(), table.column("leaf")[0].as_py())
        own = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        a = np.flatnonzero(side == 0)
        b = a if own else np.flatnonzero(side == 1)
        linked = x[a] @ x[b].T >= threshold
        if own:
            np.fill_diagonal(linked, False)
        # A pair counts in the first leaf that it shares, in whatever order leaves are compared.
        new = linked & (seen[a] @ seen[b].T == 0)
        count = np.zeros(len(ids))
        count[a] += new @ m[b]
        if not own:
            count[b] += new.T @ m[a]
        name = ids.copy()
        while True:  # smallest id that the links of this comparison reach
            low = name.copy()
            big = np.iinfo(np.int64).max
            if linked.size:
                low[a] = np.minimum(low[a], np.where(linked, low[b][None, :], big).min(1, initial=big))
                low[b] = np.minimum(low[b], np.where(linked, low[a][:, None], big).min(0, initial=big))
            if (low == name).all():
                break
            name = low
        keep = (count > 0) | (name != ids)
        return pa.table({"vec_id": ids[keep], "n": count[keep].astype(np.int64), "other": name[keep]})

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vec_id of embeddings (vec_id, embedding, label).

    Vectors of one label and length link where their cosine, in double precision, reaches the
    threshold; of such pairs almost all are found, and nothing below is. Vectors with a null label,
    null, empty or zero vectors and those with null or non-finite elements link with nothing. Rows that
    repeat a vec_id are one vector: of those that can link the least by label and elements, else the least of all. Each row with a
    null vec_id is a vector that links with nothing. Equal vectors are compared once, with their number. Other columns are
    ignored. Empty input: no rows."""
    typed = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("v", lambda e: e != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite, F.lit(False))
    rows = typed.withColumn("fit", usable)
    # Of rows that repeat a vec_id one that can link comes before one that can't.
    one = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct(~F.col("fit"), "label", "v", "fit")).alias("r")).select("vec_id", "r.label", "r.v", "r.fit")
    one = one.unionByName(rows.where("vec_id is null"))
    key = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2")]
    all_rows = write_shared(one.select("vec_id", "label", "v", "fit", *key), "emb-rows")
    valid = all_rows.where("fit").withColumn("dim", F.size("v"))
    reps = write_shared(
        valid.groupBy("label", "dim", "h1", "h2").agg(F.min(F.struct("vec_id", "v")).alias("r"), F.count("*").alias("m"))
        .select("label", "dim", "h1", "h2", "r.vec_id", "r.v", "m"), "emb-reps",
    )
    n_rows, dim = reps.agg(F.count("*"), F.max("dim")).first()
    n_label = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    if not n_rows:
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = reps.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).select("v", "label").toArrow()
    x = _matrix(sample.column("v"), dim)
    depth = max(0, min(math.ceil(math.log2(max(1, n_label / LEAF_ROWS))), int(math.log2(max(1, len(x) / 64)))))
    forest = reps.sparkSession.sparkContext.broadcast(Forest(x.astype(np.float32), sample.column("label").to_numpy(), n_rows / len(x), depth, trees, threshold))

    source = reps.select("vec_id", "m", "label", "dim", "v")
    leaves = write_shared(
        source.mapInArrow(_assign(forest, False), "label int, dim int, leaf long").groupBy("label", "dim", "leaf").agg(F.ceil(F.count("*") / TILE_ROWS).alias("tiles")).where("tiles > 1"), "emb-leaves"
    )
    rows = source.mapInArrow(_assign(forest, True), _ROW)
    tiles = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves
    rows = rows.join(tiles, ["label", "dim", "leaf"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")))
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda o: F.struct(F.least(F.col("tile"), o).alias("i"), F.greatest(F.col("tile"), o).alias("j"), F.when(F.col("tile") <= o, 0).otherwise(1).alias("side")),
    )
    rows = rows.withColumn("pair", F.explode(pair)).select("vec_id", "m", "label", "dim", "leaf", "leaves", "v", "pair.i", "pair.j", "pair.side")
    found = write_shared(
        rows.groupBy("label", "dim", "leaf", "i", "j").applyInArrow(_compare(threshold), "vec_id long, n long, other long"), "emb-found"
    )
    comp = connected_components(found.where("vec_id <> other").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    named = write_shared(
        reps.select("label", "dim", "h1", "h2", "vec_id", "m").join(counts, "vec_id", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("label", "dim", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("c")), "emb-named",
    )
    out = valid.select("vec_id", "label", "dim", "h1", "h2").join(named, ["label", "dim", "h1", "h2"]).select("vec_id", "n_links", F.col("c").alias("component_id"))
    rest = all_rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
