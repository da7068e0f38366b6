"""Removal of passages that occur more than once, by column-wise suffix sorting.

Building one suffix order of a whole collection symbol by symbol takes as many rounds as the
longest document has bytes, each over files of the whole collection. Here the same
construction runs over many small collections of short, aligned strings:

1. Every window of `length` bytes has an anchor, the least hash of the BLOCK-byte blocks in
   it. Equal windows have equal anchors at equal places, so only occurrences of one anchor
   can hold a repeated window. An occurrence carries the run of windows that it anchors.
2. Anchors that occur once are done. Runs of one anchor with the same length, place and 128-bit hash of their bytes (XXH3) repeat
   one another whole, and one of them stands for all from here on.
3. Anchors that still have different runs fetch their bytes. Runs of one anchor, aligned at it, are the
   documents of a small collection. Column by column from the right, one symbol of each run
   is inserted: the order of suffixes is refined by a stable pass over the symbols, and the
   common prefixes of neighbours are updated from the last column's. A window is repeated
   where its suffix shares `length` bytes with a neighbour. Collections come as sorted files
   of Spark's shuffle and are read once, in sequence.
4. Collections too large for a task are counted window by window instead, with map-side
   combine; the result is the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from travelfields.shared import drop_shared, scratch, small, write_shared

LENGTH = 200
BLOCK = 32
#: Runs of one anchor that one task sorts; anchors with more are counted window by window.
TASK_RUNS = 20_000
#: Runs that are sorted together, from one or more anchors.
SORT_RUNS = 8_000
SEGMENT = 1 << 18
#: Spans of up to this many texts are broadcast to the texts; more are joined by a shuffle.
BROADCAST_SPANS = 200_000
NULL_ID = -(2**63)

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)


def _mix(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def anchors(data: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, position, first window, last window, two hashes of the run's bytes, place and length) of each anchor of one text."""
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        seg = data[at : at + SEGMENT + length - 1]
        n_windows = len(seg) - length + 1
        x = _TABLE[seg]
        h, size, p = x, 1, _P
        while size < block:
            h = h[:-size] * p + h[size:]
            size, p = size * 2, np.uint64(int(p) * int(p) & (2**64 - 1))
        h = _mix(h)
        code = (h & np.uint64(~0xFFFFF & (2**64 - 1))) | np.arange(len(h), dtype=np.uint64)
        width, reach = length - block + 1, 1
        low = code
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if width > reach:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        where = (low[:n_windows] & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        last = np.concatenate((first[1:], [n_windows])) - 1
        pos = where[first]
        shape = (pos - first).astype(np.uint64) * _P + (last - first).astype(np.uint64)
        held = memoryview(np.ascontiguousarray(seg))
        digests = b"".join([xxhash.xxh3_128_digest(held[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())])
        runs = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        yield h[pos].view(np.int64), pos + at, first + at, last + at, *((runs[:, k] + shape).view(np.int64) for k in (0, 1))


_ANCHOR = "doc_id long, th long, h long, pos long, s long, e long, run long, run2 long"


def _find(length: int):
    def run(batches):
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            cols: list[list] = [[] for _ in range(8)]
            held = 0
            for doc, th, b in zip(ids, hashes, batch.column("bytes")):
                data = np.frombuffer(b.as_buffer(), np.uint8)
                for found in anchors(data, length):
                    n = len(found[0])
                    for c, v in zip(cols, (np.full(n, doc), np.full(n, th), *found)):
                        c.append(v)
                    held += n
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], _ANCHOR_NAMES)
                    cols, held = [[] for _ in range(8)], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], _ANCHOR_NAMES)

    return run


_ANCHOR_NAMES = [c.split()[0] for c in _ANCHOR.split(", ")]


def _range_max(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi] for each pair, from a table of powers of two."""
    k = np.log2(hi - lo + 1).astype(np.int64)
    out = np.empty(len(lo), levels[0].dtype)
    for level in np.unique(k):
        m = k == level
        out[m] = np.minimum(levels[level][lo[m]], levels[level][hi[m] - (1 << level) + 1])
    return out


def repeated_windows(group: np.ndarray, matrix: np.ndarray, valid: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of which runs occur in another run of their group: boolean (runs, windows).

    matrix: one aligned run a row; valid: which of its cells are in the run; first, last: the columns where a run's windows
    begin. Symbols are inserted from the last column to the first. `order` lists the runs by group and
    suffix; common[k] is the number of symbols that the suffixes k-1 and k of the order share."""
    n, width = matrix.shape
    symbol = np.where(valid, matrix.astype(np.int16) + 1, 0)  # 0: no symbol here, which matches nothing
    order = np.argsort(group, kind="stable")
    same = np.concatenate(([False], group[order][1:] == group[order][:-1]))
    common = np.where(same, 0, -1).astype(np.int32)
    biggest = int(np.max(np.diff(np.concatenate((np.flatnonzero(~same), [n]))), initial=1))
    rank = np.cumsum(~same) - 1
    out = np.zeros((n, width - length + 1), bool)
    for col in range(width - 1, -1, -1):
        sym = symbol[order, col]
        # Stable by group and symbol: the old order breaks ties, as when one symbol is inserted before each suffix.
        perm = np.argsort((rank[: n].astype(np.int64) << 9) | sym, kind="stable")
        levels, step = [common], 1
        while step < biggest:
            prev = levels[-1]
            if len(prev) <= step:
                break
            levels.append(np.minimum(prev[:-step], prev[step:]))
            step *= 2
        new_sym, new_rank = sym[perm], rank[perm]
        keep = np.zeros(n, bool)
        keep[1:] = (new_rank[1:] == new_rank[:-1]) & (new_sym[1:] == new_sym[:-1]) & (new_sym[1:] > 0)
        fresh = np.where(np.concatenate(([False], new_rank[1:] == new_rank[:-1])), 0, -1).astype(np.int32)
        at = np.flatnonzero(keep)
        if len(at):
            fresh[at] = 1 + _range_max(levels, perm[at - 1] + 1, perm[at])
        order, common = order[perm], fresh
        if col <= width - length:
            hit = common >= length
            both = hit.copy()
            both[:-1] |= hit[1:]
            rows = order[both]
            out[rows, col] = True
    cols = np.arange(width - length + 1)
    return out & (cols >= first[:, None]) & (cols <= last[:, None])


def _sort_runs(length: int):
    """Rows sorted by h; a collection that a batch cuts is carried on to the next."""
    left, width = length - BLOCK, 2 * length - BLOCK

    def solve(table: pa.Table):
        n = table.num_rows
        h, pos, s, e = (table.column(c).to_numpy() for c in ("h", "pos", "s", "e"))
        matrix, valid = np.zeros((n, width), np.uint8), np.zeros((n, width), bool)
        at = left - (pos - s)  # the run's first byte
        for k, b in enumerate(table.column("bytes")):
            data = np.frombuffer(b.as_buffer(), np.uint8)
            matrix[k, at[k] : at[k] + len(data)] = data
            valid[k, at[k] : at[k] + len(data)] = True
        group = np.unique(h, return_inverse=True)[1]
        hit = repeated_windows(group, matrix, valid, at, at + (e - s), length)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        base = (s - at)[row]
        return pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks().take(pa.array(row)), table.column("th").combine_chunks().take(pa.array(row)), pa.array(base + start), pa.array(base + end - 1 + length)],
            ["doc_id", "th", "start", "end"],
        )

    def run(batches):
        held: list = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < SORT_RUNS:
                continue
            table = pa.concat_tables(held)
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))  # the last collection may go on
            if cut:
                yield from pieces(table.slice(0, cut))
            held = [table.slice(cut)]
        if held:
            yield from pieces(pa.concat_tables(held))

    def pieces(table):
        h = table.column("h").to_numpy()
        at = 0
        while at < len(h):
            end = min(len(h), at + SORT_RUNS)
            if end < len(h):
                end = int(np.searchsorted(h, h[end], "left"))
                end = end if end > at else int(np.searchsorted(h, h[at], "right"))
            yield solve(table.slice(at, end - at))
            at = end

    return run


_WINDOW = "h long, at long, w binary, doc_id long, th long, p long"


def _windows(length: int):
    def run(batches):
        for batch in batches:
            docs, ths, h, pos, s = (batch.column(c).to_numpy() for c in ("doc_id", "th", "h", "pos", "s"))
            for k, b in enumerate(batch.column("bytes")):
                data = np.frombuffer(b.as_buffer(), np.uint8)
                p = np.arange(len(data) - length + 1)
                n = len(p)
                w = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), n, [None, pa.py_buffer(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(np.full(n, v)) if np.ndim(v) == 0 else pa.array(v) for v in (h[k], p + s[k] - pos[k], w, docs[k], ths[k], p + s[k])], ["h", "at", "w", "doc_id", "th", "p"])

    return run


def _merge_spans(batches):
    for batch in batches:
        spans = []
        for cell in batch.column("marks"):
            m = np.sort(np.array([(x["start"], x["end"]) for x in cell.as_py()], dtype=[("s", np.int64), ("e", np.int64)]), order="s")
            reach = np.maximum.accumulate(m["e"])
            new = np.concatenate(([True], m["s"][1:] > reach[:-1]))
            ends = reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(m) - 1]))]
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(m["s"][new], ends)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(spans, kind)], ["doc_id", "th", "spans"])


def _keyed(documents: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(data, F.lit("text")).alias("th"), data.alias("bytes"))


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, th, spans): for each text with repeats, the maximal runs of bytes covered by strings of `length`
    bytes that start in two or more places. th is a hash of the text; a null doc_id is NULL_ID."""
    with scratch():
        docs = _keyed(documents)
        found = write_shared(docs.where(F.octet_length("bytes") >= length).mapInArrow(_find(length), _ANCHOR), "rep-anchors")
        many = write_shared(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "rep-many")
        # Written, so that the join may split an anchor that holds many rows and the aggregate combines before it shuffles.
        shared = write_shared(found.join(many, "h"), "rep-shared")
        drop_shared(found)
        run = ["h", "run", "run2"]
        alike = write_shared(shared.groupBy(*run).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos", "s", "e")).alias("r")), "rep-runs")
        again = write_shared(alike.where("n > 1").select(*run), "rep-again")
        whole = shared.join(again, run).select("doc_id", "th", F.col("s").alias("start"), (F.col("e") + length).alias("end"))
        # Runs of the same bytes repeat one another; one of them is enough for the rest of the collection.
        sizes = write_shared(alike.groupBy("h").agg(F.count("*").alias("runs")).where("runs > 1"), "rep-sizes")
        asked = write_shared(alike.select("h", "r.*").join(sizes, "h"), "rep-asked")
        cut = F.substring("bytes", F.col("s").cast("int") + 1, (F.col("e") - F.col("s") + length).cast("int"))
        # Only texts that are asked for are shuffled: the list of them goes to the texts as long as it is short.
        wanted = write_shared(asked.select("doc_id", "th").distinct(), "rep-wanted")
        texts = docs.join(small(wanted), ["doc_id", "th"]).join(asked.hint("merge"), ["doc_id", "th"]).select("doc_id", "th", "h", "pos", "s", "e", "runs", cut.alias("bytes"))
        texts = write_shared(texts.dropDuplicates(["doc_id", "th", "pos", "s"]), "rep-texts")
        few = texts.where(F.col("runs") <= TASK_RUNS).drop("runs").repartition("h").sortWithinPartitions("h")
        marks = write_shared(whole.unionByName(few.mapInArrow(_sort_runs(length), "doc_id long, th long, start long, end long")), "rep-marks")
        large = texts.where(F.col("runs") > TASK_RUNS).drop("runs")
        if not large.isEmpty():
            windows = write_shared(large.mapInArrow(_windows(length), _WINDOW), "rep-windows")
            twice = windows.groupBy("h", "at", "w").agg(F.count("*").alias("n")).where("n > 1").drop("n")
            marks = marks.unionByName(windows.join(write_shared(twice, "rep-twice"), ["h", "at", "w"]).select("doc_id", "th", F.col("p").alias("start"), (F.col("p") + length).alias("end")))
        grouped = marks.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("marks"))
        return write_shared(grouped.mapInArrow(_merge_spans, "doc_id long, th long, spans array<struct<start:long,end:long>>"), "rep-spans", keep=True)


def remove_repeats(documents: DataFrame, length: int = LENGTH, *kept) -> DataFrame:
    """kept columns of each row of documents (doc_id, text), and n_bytes, n_removed, n_spans and left (binary).

    Every byte covered by a string of `length` bytes that also starts anywhere else is removed: in another document or
    the same one, overlapping itself or not, judged on the input. Matches never cross documents.
    A null text is empty, and texts below `length` bytes keep all. Repeated rows are repeats of one another
    and lose all that is at least `length` long. A null doc_id is a document like any other. Columns are
    not read but for doc_id, text and kept. Empty input: no rows."""
    spans = small(repeated_spans(documents, length), BROADCAST_SPANS).withColumnsRenamed({"doc_id": "_rep_doc", "th": "_rep_th"})
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = documents.select(
        F.struct(*(kept or ("doc_id",))).alias("_kept"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_rep_doc"), F.xxhash64(data, F.lit("text")).alias("_rep_th"), data.alias("_bytes")
    )
    both = base.join(spans, ["_rep_doc", "_rep_th"], "left")
    size = F.octet_length("_bytes").cast("long")
    edge = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<binary>").alias("parts"))
    part = lambda a, b: F.substring(F.col("_bytes"), (a + 1).cast("int"), (b - a).cast("int"))
    walked = F.aggregate("spans", edge, lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["parts"], F.array(part(acc["at"], x["start"]))).alias("parts")))
    both = both.withColumn("_walk", walked)
    left = F.when(F.col("spans").isNull(), F.col("_bytes")).otherwise(
        F.aggregate(F.concat(F.col("_walk.parts"), F.array(part(F.col("_walk.at"), size))), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x))
    )
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]), F.lit(0).cast("long"))
    return both.select("_kept.*", size.alias("n_bytes"), gone.alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), left.alias("left"))
