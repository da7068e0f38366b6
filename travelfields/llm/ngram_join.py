"""Exact Jaccard join of word 5-gram sets with signature trees.

1. Each text becomes the set of its shingles; texts with equal sets form a class, and one
   text of each class goes on.
2. Under one global order of shingles, rare ones first, two sets at or above the threshold share a
   shingle of their prefixes. The texts that share a prefix shingle are the root of a tree.
3. Stars come first, as an order of work: each text is compared with one other, the least text of the roots
   that it shares most prefix shingles with. Most roots are groups of copies and end here, in as many pairs as texts.
4. What a root still holds of different components goes through its tree: texts in order of size and least
   bit form leaves and nodes, which hold the OR of their texts' bitmaps and the range of their sizes. The dual
   traversal drops pairs of nodes, of leaves and of texts where the largest overlap that bitmaps and sizes
   allow is too small, or where both sides are one component already. A first wave proposes a forest of
   text pairs over components, the second, over what is then still apart, all. So links inside a component are not all enumerated.
5. A pair goes on only if the counts of shingles by hash bucket allow enough overlap, and is then compared exactly.

Neither the order of shingles nor the choice of stars changes which components come out."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from travelfields.llm.text import row_hash
from travelfields.operators.components import connected_components
from travelfields.shared import scratch, small, write_shared

N_WORDS = 5
PERCENT = 75
#: Longs in the bitmap by which nodes of large roots are compared, and the least of a text's own.
SIG_LONGS = 16
#: A text's bitmap has 16 bits for each shingle, rounded up to a power of two, up to these longs.
MOST_LONGS = 64
#: Hash buckets by which a text's shingles are counted, one byte each.
BUCKETS = 1024
#: How many frequent shingles are told apart when shingles are ordered; it bounds the broadcast to 2 MB.
FREQUENT = 250_000
#: Links go to a smaller row, through few steps: so many rounds of joining components go by row before any goes by hash.
ROUNDS_BY_ROW = 3
#: Waves of trees: the first proposes pairs that would join all components if they linked, the last all pairs.
WAVES = (True, False)
#: Roots of up to this many texts propose all their pairs in the first wave and are done.
FULL_ROWS = 8
#: Texts of a node (of a root that has more), of an inner node and of a leaf.
NODE_ROWS, INNER_ROWS, LEAF_ROWS = 2048, 64, 8
#: Rows of roots that are traversed in one task's turn.
TURN_ROWS = 8192
#: Texts compared with one other text in one task.
CHUNK = 512
BUFFER = 1 << 21

_P = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


#: Words are hashed in pieces of a text of about this many bytes.
SEGMENT = 1 << 18
#: Longer words are hashed one by one.
WORD_BYTES = 24
_FOLDED = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE = np.random.default_rng(10).integers(0, 2**64, 256, np.uint64)
with np.errstate(over="ignore"):
    _UP = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(SEGMENT, _P))))
    _DOWN = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(SEGMENT, np.uint64(pow(int(_P), -1, 2**64))))))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text in UTF-8: A-Z folded, cut at the bytes \\x20 and \\x09-\\x0D. The hash of a word of up to WORD_BYTES
    is a polynomial of its bytes, taken as the difference of two running sums. Modulo 2^64 such polynomials are equal for some pairs of
    long words of two letters whatever the bytes' values, so longer words are hashed by XXH3."""
    text = text.translate(_FOLDED)
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > SEGMENT:
            end = text.rfind(b" ", at, at + SEGMENT)
            if end <= at:
                end = text.find(b" ", at + 1)
                end = len(text) if end < 0 else end
        piece = text[at:end].strip(b" ")
        at = end
        if len(piece) > SEGMENT:
            out.append(np.array([xxhash.xxh3_64_intdigest(piece)], np.uint64))
        elif piece:
            data = np.frombuffer(piece, np.uint8)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * _UP[: len(data)], out=sums[1:])
            inside = data != 32
            edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
            start, stop = np.concatenate(([0], edge[1::2])), np.concatenate((edge[::2], [len(data)]))
            found = (sums[stop] - sums[start]) * _DOWN[start]
            for k in np.flatnonzero(stop - start > WORD_BYTES):
                found[k] = xxhash.xxh3_64_intdigest(piece[start[k] : stop[k]])
            out.append(found)
    return _mixed(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def shingles(text: bytes | None, n: int = N_WORDS) -> np.ndarray:
    """64-bit hashes of the shingles of a text in UTF-8, in their order, as int64."""
    with np.errstate(over="ignore"):
        h = word_hashes(text or b"")
        if not len(h):
            return np.zeros(0, np.int64)
        size = min(n, len(h))
        m = len(h) - size + 1
        acc = np.full(m, size, np.uint64)
        for i in range(size):
            acc = acc * _P + h[i : i + m]
        return _mixed(acc).view(np.int64)


def shingle_set(text: bytes | None, n: int = N_WORDS) -> np.ndarray:
    """Sorted distinct shingles."""
    s = np.sort(shingles(text, n))
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _eligible(s: np.ndarray) -> np.ndarray:
    """Three eighths of all shingles, by their hash: these come first in the order, and only they are counted. Prefixes hold a quarter."""
    return s >= 1 << 61


def _short(s: np.ndarray) -> np.ndarray:
    return s.astype(np.uint64).astype(np.uint32).view(np.int32)


def _count(n_words: int):
    def run(batches):
        buf, held = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(buf), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int32))], ["key", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                s = shingles(t.as_py(), n_words)
                buf.append(_short(s[_eligible(s)]))
                held += len(buf[-1])
                if held >= BUFFER:
                    yield flush()
                    buf, held = [], 0
        if held:
            yield flush()

    return run


def frequent_shingles(docs: DataFrame, n_words: int = N_WORDS, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent eligible shingles, by 32 bits of their hash, and their rank by count over the whole corpus. Any shingle
    that isn't listed is rarer than all that are."""
    rows = docs.select("text").mapInArrow(_count(n_words), "key int, n int").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 4")
    top = rows.orderBy(F.desc("n"), "key").limit(most).toPandas().sort_values("key")
    rank = np.empty(len(top), np.int32)
    rank[np.lexsort((top["key"].to_numpy(), top["n"].to_numpy()))] = np.arange(1, len(top) + 1)
    return top["key"].to_numpy(np.int32), rank


def _signature(s: np.ndarray) -> np.ndarray:
    """A text's bitmap as longs. A wider one folds into a narrower one by OR of its parts."""
    longs = min(MOST_LONGS, max(SIG_LONGS, 1 << max(0, len(s) // 4 - 1).bit_length()))
    bits = np.zeros(longs * 64, np.uint8)
    bits[(s.view(np.uint64) % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _bucket_counts(s: np.ndarray) -> bytes:
    """Shingles by bucket, from other bits of the hash than the bitmap; a bucket holds 255 at most."""
    k = (s.view(np.uint64) >> np.uint64(40)) % np.uint64(BUCKETS)
    return np.minimum(np.bincount(k.astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    a, b = np.frombuffer(d, np.int64)
    return int(a), int(b)


def prefix(s: np.ndarray, keys: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set in the global order: eligible ones by count, then the others, each by hash."""
    weight = np.zeros(len(s), np.int64)
    if len(keys) and len(s):
        short = _short(s)
        k = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
        weight = np.where(keys[k] == short, rank[k], 0).astype(np.int64)
    weight[~_eligible(s)] = 1 << 40
    return s[np.lexsort((s, weight))[: prefix_length(len(s), percent)]] if len(s) else s


_SET = "h1 long, h2 long, doc_id long, n long, d1 long, d2 long, sig array<long>, prefix array<long>, counts binary"


def _describe(frequent, n_words: int, percent: int):
    names = [c.split()[0] for c in _SET.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        keys, rank = frequent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                cols: list[list] = [[] for _ in range(6)]
                for t in b.column("text").cast(pa.binary()):
                    s = shingle_set(t.as_py(), n_words)
                    row = (len(s), *_digest(s), _signature(s), prefix(s, keys, rank, percent), _bucket_counts(s))
                    for c, v in zip(cols, row):
                        c.append(v)
                arrays = [*(b.column(c) for c in ("h1", "h2", "doc_id")), *(pa.array(c, kind) for c, kind in zip(cols, kinds[3:]))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _local_stars(batches):
    """Per batch, (key, doc, star): star is null for the least text of a key, which goes on to meet other batches,
    and that text for the others of the batch. So a shingle in very many texts is met once for each batch."""
    for batch in batches:
        docs = batch.column("row").to_numpy(zero_copy_only=False)
        lists = batch.column("prefix")
        counts = np.diff(lists.offsets.to_numpy())
        keys = lists.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(docs, counts)
        order = np.lexsort((doc, keys))
        keys, doc = keys[order], doc[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        lead = doc[first][np.cumsum(first) - 1] if len(keys) else doc
        for i in range(0, len(keys), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[j]), pa.array(doc[j]), pa.array(lead[j], mask=first[j])], ["key", "doc", "star"])


def _sets(n_words: int):
    def run(batches):
        for batch in batches:
            rows, texts = batch.column("row"), batch.column("text").cast(pa.binary())
            for at in range(0, len(rows), 256):
                part = [shingle_set(t.as_py(), n_words).tobytes() for t in texts[at : at + 256]]
                yield pa.RecordBatch.from_arrays([rows[at : at + 256], pa.array(part, pa.binary())], ["row", "grams"])

    return run


def _compare(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a_id, b_ids = [], []
        if left.num_rows:
            a = np.frombuffer(left.column("grams_lead")[0].as_py(), np.int64)
            for b_id, grams in zip(right.column("b").to_pylist(), right.column("grams")):
                b = np.frombuffer(grams.as_py(), np.int64)
                k = np.searchsorted(a, b)
                both = int((a[np.minimum(k, len(a) - 1)] == b).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    a_id.append(left.column("a_lead")[0].as_py())
                    b_ids.append(b_id)
        return pa.table({"a": pa.array(a_id, pa.int64()), "b": pa.array(b_ids, pa.int64())})

    return run


def _overlap_allowed(percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                n_a, n_b = (b.column(c).to_numpy() for c in ("n_a", "n_b"))
                a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS) for k in ("counts_a", "counts_b"))
                # What a full bucket doesn't hold may all be shared.
                most = np.minimum(a, c).sum(1, dtype=np.int64) + np.minimum(n_a - a.sum(1, dtype=np.int64), n_b - c.sum(1, dtype=np.int64))
                keep = pa.array(100 * most >= percent * (n_a + n_b - most))
                yield pa.RecordBatch.from_arrays([b.column(k).filter(keep) for k in ("a", "b")], ["a", "b"])

    return run


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those whose sizes and then bucket counts allow the threshold, as a written table; none that reaches
    it is lost. Bucket counts are moved only for texts of pairs whose sizes fit."""
    with scratch():
        of = lambda c, *cols: sets.select(F.col("row").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in cols))
        fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
        sized = pairs.select("a", "b").join(of("a", "n"), "a").join(of("b", "n"), "b").where(fits)
        sized = write_shared(sized, "ngram-sized")
        ids = write_shared(sized.select(F.col("a").alias("row")).union(sized.select("b")).distinct(), "ngram-sized-ids")
        counts = write_shared(sets.select("row", "counts").join(small(ids), "row"), "ngram-counts")
        of = lambda c: counts.select(F.col("row").alias(c), F.col("counts").alias(f"counts_{c}"))
        both = sized.join(of("a"), "a").join(of("b"), "b")
        return write_shared(both.mapInArrow(_overlap_allowed(percent), "a long, b long"), "ngram-plausible", keep=True)


def verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold, as a written table. Only the texts in pairs are read into sets, and the
    partners of one text are split in chunks. pairs is a written table, docs has h1, h2 and text."""
    with scratch():
        ids = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct().join(sets.select("row", "h1", "h2"), "row")
        few = small(write_shared(ids, "ngram-ids"))
        # Rows that repeat one another have one hash: one of them is enough.
        texts = docs.join(few, ["h1", "h2"]).groupBy("row").agg(F.first("text").alias("text"))
        grams = write_shared(texts.mapInArrow(_sets(n_words), "row long, grams binary"), "ngram-sets")
        sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        chunk = F.pmod(F.xxhash64("b"), F.lit(1 << 30)) % F.col("chunks")
        chunked = write_shared(pairs.join(sizes, "a").select("a", "b", chunk.alias("chunk")), "ngram-pairs")
        lead = chunked.select("a", "chunk").distinct().join(grams, F.col("a") == F.col("row")).select("a", "chunk", "grams").toDF("a_lead", "chunk_lead", "grams_lead")
        rest = chunked.join(grams, F.col("b") == F.col("row")).select("a", "chunk", "b", "grams")
        links = lead.groupBy("a_lead", "chunk_lead").cogroup(rest.groupBy("a", "chunk")).applyInArrow(_compare(percent), "a long, b long")
        return write_shared(links, "ngram-links", keep=True)


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The same bitmap in a width (longs) that divides its own."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, size), 0)


def _least_bit(bitmap: np.ndarray) -> int:
    at = int(np.argmax(bitmap != 0))
    word = int(bitmap[at])
    return 64 * at + (word & -word).bit_length()


class _Node:
    """Texts of a tree: rows in the task's arrays, the OR of their bitmaps, the range of their sizes and their set bits."""

    def __init__(self, rows, maps, n, kids=()):
        size = min(len(m) for m in maps)
        maps = [_fold(m, size) for m in maps]
        self.rows, self.kids, self.map = rows, kids, np.bitwise_or.reduce(maps)
        self.pop = min(k.folded_pop(size) for k in kids) if kids else min(int(np.bitwise_count(m).sum()) for m in maps)
        self.lo, self.hi = n[rows].min(), n[rows].max()
        self.maps = None if kids else np.stack(maps)

    def folded_pop(self, size: int) -> int:
        """Bits that each text below has at least, in this width."""
        if size == len(self.map):
            return self.pop
        return min(k.folded_pop(size) for k in self.kids) if self.kids else min(int(np.bitwise_count(_fold(m, size)).sum()) for m in self.maps)


def _apart(a: _Node, b: _Node, percent: int) -> bool:
    """Whether no text of a can link a text of b."""
    if 100 * a.hi < percent * b.lo or 100 * b.hi < percent * a.lo:
        return True
    size = min(len(a.map), len(b.map))
    shared = int(np.bitwise_count(_fold(a.map, size) & _fold(b.map, size)).sum())
    most = min(a.hi - max(0, a.folded_pop(size) - shared), b.hi - max(0, b.folded_pop(size) - shared))
    return (100 + percent) * most < percent * (a.lo + b.lo)


class _Labels:
    """Components of a turn's texts; with `forest` a proposed pair counts as a link at once."""

    def __init__(self, comp: np.ndarray, forest: bool):
        self.forest = forest
        self.code = np.unique(comp, return_inverse=True)[1]
        self.label = np.arange(int(self.code.max(initial=-1)) + 1)

    def of(self, rows: np.ndarray) -> np.ndarray:
        return self.label[self.code[rows]]

    def join(self, c: int, d: int) -> None:
        self.label[self.label == d] = c


def traverse(left: np.ndarray, right: np.ndarray | None, maps: list[np.ndarray], n: np.ndarray, labels: _Labels, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Text pairs that the dual traversal of two trees (of one, if right is None) leaves. left, right: rows of the arrays."""

    def tree(rows):
        least = np.array([_least_bit(_fold(maps[i], SIG_LONGS)) for i in rows])
        of = labels.of(rows)
        count = np.unique(of, return_inverse=True, return_counts=True)
        own = np.where(count[2][count[1]] >= LEAF_ROWS, of, -1)  # larger components have leaves of their own
        rows = rows[np.lexsort((least, n[rows], own))]
        leaves = [_Node(r, [maps[i] for i in r], n) for r in (rows[k : k + LEAF_ROWS] for k in range(0, len(rows), LEAF_ROWS))]
        step = INNER_ROWS // LEAF_ROWS
        groups = [leaves[k : k + step] for k in range(0, len(leaves), step)]
        return [_Node(np.concatenate([x.rows for x in g]), [x.map for x in g], n, g) for g in groups]

    out = []

    def visit(a: _Node, b: _Node):
        la, lb = labels.of(a.rows), labels.of(b.rows)
        if (la == la[0]).all() and (lb == la[0]).all() or _apart(a, b, percent):
            return
        if a.kids:
            for p, x in enumerate(a.kids):
                for y in a.kids[p:] if a is b else b.kids:
                    visit(x, y)
            return
        size = min(a.maps.shape[1], b.maps.shape[1])
        ma, mb = (np.bitwise_or.reduce(x.maps.reshape(len(x.rows), -1, size), 1) for x in (a, b))
        shared = np.bitwise_count(ma[:, None, :] & mb[None, :, :]).sum(2, dtype=np.int64)
        pop_a, pop_b = (np.bitwise_count(m).sum(1, dtype=np.int64) for m in (ma, mb))
        na, nb = n[a.rows], n[b.rows]
        overlap = np.minimum(na[:, None] - (pop_a[:, None] - shared), nb[None, :] - (pop_b[None, :] - shared))
        over = (100 + percent) * overlap - percent * (na[:, None] + nb[None, :])
        x, y = np.nonzero((over >= 0) & (la[:, None] != lb[None, :]))
        if labels.forest and len(x):
            kept = []
            for k in np.argsort(-over[x, y], kind="stable"):  # what overlaps most first
                c, d = (int(labels.label[labels.code[i]]) for i in (a.rows[x[k]], b.rows[y[k]]))
                if c != d:
                    labels.join(c, d)
                    kept.append(k)
            x, y = x[kept], y[kept]
        out.append((a.rows[x], b.rows[y]))

    first = tree(left)
    second = first if right is None else tree(right)
    for p, a in enumerate(first):
        for b in first[p:] if right is None else second:
            visit(a, b)
    return out


def _turn(percent: int, forest: bool):
    """All roots, or pairs of nodes of large roots, of one turn."""

    def run(table: pa.Table) -> pa.Table:
        key, i, j, side, doc, n, comp = (table.column(c).to_numpy() for c in ("key", "i", "j", "side", "doc", "n", "comp"))
        lists = table.column("sig").combine_chunks()
        maps = np.split(lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py())
        order = np.lexsort((side, j, i, key))
        edge = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        found, known, grown = [], _Labels(comp, False), _Labels(comp, forest)
        for rows in np.split(order, edge):
            own = i[rows[0]] == j[rows[0]]
            labels = known if len(rows) <= FULL_ROWS else grown
            of = labels.of(rows)
            if (of != of[0]).any():
                found += traverse(rows if own else rows[side[rows] == 0], None if own else rows[side[rows] == 1], maps, n, labels, percent)
        a, b = (np.concatenate([doc[f[k]] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return run


def tree_candidates(members: DataFrame, percent: int = PERCENT, forest: bool = False) -> DataFrame:
    """members: written (key, doc, n, comp, sig), roots by key. Returns distinct pairs (a, b) of different components whose
    largest possible overlap reaches the threshold: all, or with `forest` in each turn as many as would join
    its components.

    A root of more than NODE_ROWS texts is split into nodes by size band, component and least bit, and pairs of its nodes that the
    bounds leave are traversed each on its own."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / NODE_ROWS).alias("nodes"))
    band = F.floor(F.log(F.col("n")) / math.log(1.15)).cast("long")
    # The least bit that is set, as longs by place and value, stands for the least shingle.
    place = F.expr("array_position(transform(sig, x -> x <> 0), true)").cast("int")
    least = F.element_at("sig", place)
    below = F.coalesce(F.try_subtract(least, F.lit(1)), F.lit(2**63 - 1))
    alike = F.when(F.col("comp") == F.col("doc"), F.xxhash64(place, least.bitwiseAND(F.bitwise_not(below)))).otherwise(F.xxhash64("comp"))
    node = F.when(F.col("nodes") == 1, F.lit(0)).otherwise(band * (1 << 32) + F.pmod(alike, F.col("nodes")))
    tiled = write_shared(members.join(sizes, "key").withColumn("node", node.cast("long")), "ngram-nodes")
    one = tiled.where("nodes = 1").select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "doc", "n", "comp", "sig", F.lit(0).alias("side"))
    large = tiled.where("nodes > 1").drop("nodes")
    if not large.isEmpty():
        bit = [F.expr(f"aggregate(sequence({k}, size(sig) - 1, {SIG_LONGS}), 0L, (o, x) -> o | sig[x])").alias(f"s{k}") for k in range(SIG_LONGS)]
        pop = sum((F.bit_count(f"s{k}") for k in range(1, SIG_LONGS)), F.bit_count("s0"))
        nodes = large.select("key", "node", "n", "comp", *bit).withColumn("pop", pop).groupBy("key", "node").agg(
            F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pop").alias("pop"), F.min("comp").alias("c"), F.max("comp").alias("d"),
            *(F.bit_or(f"s{k}").alias(f"s{k}") for k in range(SIG_LONGS)),
        )
        nodes = write_shared(nodes, "ngram-tree")
        a, b = (nodes.select(*(F.col(c).alias(c if c == "key" else f"{s}_{c}") for c in nodes.columns)) for s in "ab")
        shared = sum((F.bit_count(F.col(f"a_s{k}").bitwiseAND(F.col(f"b_s{k}"))) for k in range(1, SIG_LONGS)), F.bit_count(F.col("a_s0").bitwiseAND(F.col("b_s0"))))
        lost = lambda s: F.greatest(F.lit(0), F.col(f"{s}_pop") - shared)
        largest = F.least(F.col("a_hi") - lost("a"), F.col("b_hi") - lost("b"))
        pairs = a.join(b, "key").where(
            (F.col("a_node") <= F.col("b_node"))
            & ~((F.col("a_c") == F.col("a_d")) & (F.col("b_c") == F.col("b_d")) & (F.col("a_c") == F.col("b_c")))
            & (F.col("a_hi") * 100 >= F.col("b_lo") * percent) & (F.col("b_hi") * 100 >= F.col("a_lo") * percent)
            & (largest * (100 + percent) >= (F.col("a_lo") + F.col("b_lo")) * percent)
        ).select("key", F.col("a_node").alias("i"), F.col("b_node").alias("j"))
        pairs = write_shared(pairs, "ngram-node-pairs")
        for c, s in (("i", 0), ("j", 1)):
            part = (pairs if s == 0 else pairs.where("i <> j")).join(large.withColumnRenamed("node", c), ["key", c]).withColumn("side", F.lit(s))
            one = one.unionByName(part.select(*one.columns))
    one = write_shared(one, "ngram-turns")
    turns = max(1, one.count() // TURN_ROWS)
    return one.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(turns)).alias("turn")).applyInArrow(_turn(percent, forest), "a long, b long").distinct()


def _joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links between them."""
    if comp is None:
        return connected_components(links, rounds_by_id=ROUNDS_BY_ROW)
    more = connected_components(_with(_with(links, comp, "a"), comp, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")), rounds_by_id=ROUNDS_BY_ROW)
    up = more.select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = comp.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = more.join(comp.select("node"), "node", "left_anti")
    return write_shared(old.unionByName(new.select("node", "component")), "ngram-comp")


def _with(df: DataFrame, comp: DataFrame, c: str) -> DataFrame:
    named = comp.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    return df.join(named, c, "left").withColumn(f"c_{c}", F.coalesce(f"c_{c}", c))


def _linked(sets: DataFrame, docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """(row, component) of written sets that have links or copies, as rows."""
    usable = sets.where("n > 0")
    classes = write_shared(usable.groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k"), "ngram-classes")
    copies = write_shared(usable.select("row", "d1", "d2").join(small(classes), ["d1", "d2"]).where("row <> rep").select("row", "rep"), "ngram-copies")
    reps = usable.join(small(copies.select("row")), "row", "left_anti")
    stars = reps.select("row", "prefix").mapInArrow(_local_stars, "key long, doc long, star long")
    # Stars of a batch only ride along; a salt keeps those of a common shingle apart.
    salt = F.when(F.col("star").isNull(), F.lit(0)).otherwise(F.col("doc"))
    lead = F.min("doc").over(W.partitionBy("key", salt))
    stars = write_shared(stars.withColumn("a", F.coalesce("star", lead)).where("a <> doc").select("key", "a", F.col("doc").alias("b")), "ngram-stars")

    sizes = sets.select("row", "n", "counts")
    met = stars.groupBy("a", "b").agg(F.count("*").alias("shared"))
    tried = write_shared(met.groupBy("b").agg(F.max(F.struct("shared", -F.col("a"))).alias("m")).select((-F.col("m")["col2"]).alias("a"), "b"), "ngram-best")
    comp = _joined(None, verify(plausible(tried, sizes, percent), sets, docs, n_words, percent))
    texts = write_shared(stars.select("key", F.col("a").alias("doc")).union(stars.select("key", "b")).distinct(), "ngram-texts")
    for forest in WAVES:
        members = write_shared(_with(texts, comp, "doc").withColumnRenamed("c_doc", "comp"), "ngram-members")
        # Roots with the same texts give the same pairs: one of them is enough. A root of two texts is a pair.
        same_texts = (F.bit_xor(F.xxhash64("doc")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("second"), "doc")).alias("x2"))
        apart = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("texts"), F.min("doc").alias("a"), F.max("doc").alias("b"), *same_texts)
        apart = apart.where("lo <> hi") if forest else apart.where("lo <> hi").where(F.col("texts") > FULL_ROWS)
        apart = write_shared(apart.groupBy("texts", "x1", "x2").agg(F.min("key").alias("key"), F.min("a").alias("a"), F.min("b").alias("b")), "ngram-apart")
        if apart.isEmpty():
            break
        roots = members.join(apart.where("texts > 2").select("key"), "key").join(sets.select(F.col("row").alias("doc"), "n", "sig"), "doc")
        found = apart.where("texts = 2").select("a", "b").unionByName(tree_candidates(write_shared(roots, "ngram-roots"), percent, forest)).distinct()
        found = write_shared(found.join(tried, ["a", "b"], "left_anti"), "ngram-found")
        rest = plausible(found, sizes, percent)
        if not rest.isEmpty():
            comp = _joined(comp, verify(rest, sets, docs, n_words, percent))
        tried = tried.unionByName(found)
    copies = _with(copies.withColumnRenamed("rep", "a"), comp, "a").select("row", F.col("c_a").alias("component"))
    return copies.unionByName(comp.select(F.col("node").alias("row"), "component"))


def jaccard_rows(documents: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT, identity: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, h1, h2, is_first) for each row of documents (doc_id, text), as jaccard_groups has it.

    h1 and h2 are a hash of the identity columns (doc_id and text, if none are given); is_first marks one row of
    each component: that with the smallest doc_id, null ids last. A row without shingles is a component of its own."""
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_hash(*(identity or (F.col("doc_id"), F.col("text")))))
    with scratch():
        docs = keyed.select("h1", "h2", "doc_id", "text")
        frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n_words))
        # The number that a row gets when it is written names it from here on.
        sets = write_shared(docs.mapInArrow(_describe(frequent, n_words, percent), _SET).withColumn("row", F.monotonically_increasing_id()), "ngram-docs")
        linked = write_shared(_linked(sets, docs, n_words, percent), "ngram-linked")
        rows = sets.select("row", "doc_id", "h1", "h2", F.col("n").alias("n_shingles")).join(linked, "row", "left").withColumn("component", F.coalesce("component", "row"))
        rows = write_shared(rows, "ngram-rows", keep=True)
        several = rows.join(linked.select("component").distinct(), "component", "left_semi")
        nulls_last = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        first = several.groupBy("component").agg(F.min("doc_id").alias("least"), F.min(nulls_last)["row"].alias("first"))
        first = write_shared(first, "ngram-first", keep=True)
    out = rows.join(first, "component", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "h1", "h2", (F.coalesce("first", "row") == F.col("row")).alias("is_first"))


def jaccard_groups(documents: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of documents (doc_id, text).

    Texts link where 100 * |A and B| >= percent * |A or B|; component_id is the smallest doc_id reachable.
    A text of fewer than n_words words is one shingle; a null, empty or blank text has no shingle, links
    with nothing and is its own component. Equal texts link always. Each row is a document: rows that
    repeat a doc_id with different texts link by their own texts, and a row with a null doc_id links like any
    other, but names no component (null if no row of it has an id). Very long texts are hashed in pieces. Other columns
    are ignored. Empty input: no rows."""
    return jaccard_rows(documents, n_words, percent).select("doc_id", "n_shingles", "component_id")
