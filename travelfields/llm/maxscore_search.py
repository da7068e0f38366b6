"""Ranked lexical search by Block-Max MaxScore over compressed segments.

Documents are read once into segments of bounded size, wherever they lie: postings of the asked terms in compressed blocks, each with the pairs of
(occurrences, length) that no other pair of the block beats, so that its best score follows once the corpus is counted. A segment's lists
are split by the score that is to be beaten: lists whose best scores together don't reach it can't bring a document in alone. The others
are read window by window; the documents found there meet the remaining lists only where the score so far, the best of the block they would stand in and the
best of the lists still to come exceed that score, which is looked at before a block is unpacked. Each segment gives a heap of the best for each item; heaps
are merged by a window that cuts before it shuffles.

Scores are integers and every segment holds whole documents, so the result doesn't depend on how they are dealt."""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from travelfields.shared import scratch, write_shared

#: Documents returned for an item.
TOP = 50
#: Documents and bytes of text of a segment at most (a longer document is a segment of its own), postings of a block, documents of a window.
SEGMENT_DOCS, SEGMENT_BYTES, BLOCK, WINDOW = 8192, 1 << 24, 128, 1024
#: Items and bytes of their texts that are searched together; more are searched in further passes.
ITEMS_TOGETHER, ITEM_BYTES = 2000, 1 << 23
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and whatever isn't ASCII, A-Z folded."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return data.translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count and a document's length give a term, before its weight: it grows with tf and falls with n."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))


_PARTS = {"n": np.int64, "terms": np.int32, "df": np.int64, "last": np.int32, "at": np.int64, "width": np.uint8, "edge": np.int64, "edge_tf": np.int64, "edge_n": np.int64}


def _segment(ids: list, lengths: list[int], term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> dict:
    """Postings (term, doc, tf) of documents numbered by ascending id, as a row."""
    order = np.lexsort((doc, term))
    term, doc, tf = term[order], doc[order], tf[order].astype(np.int64)
    n = np.array(lengths, np.int64)
    names, first, df = np.unique(term, return_index=True, return_counts=True)
    starts = np.concatenate([np.arange(f, f + c, BLOCK) for f, c in zip(first, df)]) if len(names) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(doc)))
    body, at, width = bytearray(), [], []
    for s, size in zip(starts.tolist(), sizes.tolist()):
        for values in (np.diff(doc[s : s + size], prepend=doc[s]), tf[s : s + size]):
            wide = next(w for w in (1, 2, 4, 8) if values.max() < 1 << (8 * w - 1))
            at.append(len(body))
            width.append(wide)
            body += values.astype(f"<i{wide}").tobytes()
    block = np.repeat(np.arange(len(starts)), sizes)
    by = np.lexsort((-tf, n[doc], block))
    step = int(tf.max()) + 1 if len(tf) else 1
    high = np.maximum.accumulate(block[by] * step + tf[by]) if len(by) else by
    keep = by[np.concatenate(([True], high[1:] > high[:-1]))] if len(by) else by
    edge = np.searchsorted(block[keep], np.arange(len(starts)))
    out = {"n": n, "terms": names, "df": df, "last": doc[starts + sizes - 1] if len(starts) else starts, "at": np.array(at), "width": np.array(width), "edge": edge, "edge_tf": tf[keep], "edge_n": n[doc[keep]]}
    # A block begins at its first document, which its deltas leave out.
    return {k: np.asarray(out[k]).astype(t).tobytes() for k, t in _PARTS.items()} | {"first": (doc[starts] if len(starts) else starts).astype(np.int32).tobytes(), "body": bytes(body), "doc_ids": ids, "n_docs": int((n > 0).sum()), "n_terms": int(n.sum())}


_ROW = "n_docs long, n_terms long, body binary, first binary, " + ", ".join(f"{k} binary" for k in _PARTS)


def _index(batches, wanted: dict[bytes, int], schema: pa.Schema):
    """Arrow batches (doc_id, text) to segments. wanted: numbers of the terms that are asked for."""
    held, size = [], 0

    def flush():
        held.sort(key=lambda x: (x[0] is not None, x[0]))
        who, what, often = array("i"), array("i"), array("q")
        for k, (_, _, found) in enumerate(held):
            what.extend(found)
            often.extend(found.values())
            who.extend([k] * len(found))
        row = _segment([x[0] for x in held], [x[1] for x in held], np.array(what, np.int32), np.array(who, np.int32), np.array(often, np.int64))
        held.clear()
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_binary())
        for k in range(batch.num_rows):
            text = texts[k].as_py() or b""
            if held and size + len(text) > SEGMENT_BYTES:
                yield flush()
                size = 0
            found = terms(text)
            counts = Counter(found)
            held.append((ids[k].as_py(), len(found), {wanted[t]: c for t, c in counts.items() if t in wanted}))
            size += len(text)
            if len(held) == SEGMENT_DOCS:
                yield flush()
                size = 0
    if held:
        yield flush()


class _Segment:
    """A segment as it is read back; blocks are unpacked when asked for and stay unpacked for the items that follow."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        for k, t in _PARTS.items():
            setattr(self, k, np.frombuffer(row[k], t))
        self.first, self.body, self.ids = np.frombuffer(row["first"], np.int32), row["body"], row["doc_ids"]
        self.n_docs, self.n_terms, self.open = n_docs, n_terms, {}
        self.weights = weights[self.terms]
        blocks = -(-self.df // BLOCK)
        self.start = np.concatenate(([0], np.cumsum(blocks)))
        self.of = np.repeat(np.arange(len(self.terms)), blocks)
        bound = np.maximum.reduceat(_impact(self.edge_tf, self.edge_n, n_docs, n_terms), self.edge) if len(self.edge) else np.zeros(0, np.int64)
        self.bound = bound * self.weights[self.of] if len(self.of) else bound
        self.best = np.maximum.reduceat(self.bound, self.start[:-1]) if len(self.terms) else np.zeros(0, np.int64)
        self.place = {int(t): k for k, t in enumerate(self.terms)}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, what they get) of a block."""
        if b not in self.open:
            t = self.of[b]
            size = min(BLOCK, int(self.df[t] - (b - self.start[t]) * BLOCK))
            gaps, tf = (np.frombuffer(self.body, f"<i{self.width[2 * b + k]}", size, self.at[2 * b + k]) for k in (0, 1))
            docs = self.first[b] + np.cumsum(gaps, dtype=np.int64)
            self.open[b] = docs, self.weights[t] * _impact(tf.astype(np.int64), self.n[docs], self.n_docs, self.n_terms)
        return self.open[b]

    def search(self, asked: list[int], top: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, documents) of the best, documents in ascending order win ties."""
        lists = [k for t in asked if (k := self.place.get(t)) is not None and self.best[k] > 0]
        lists.sort(key=lambda k: self.best[k])
        below = np.concatenate(([0], np.cumsum(self.best[lists]))) if lists else np.zeros(1, np.int64)
        scores, docs, beat = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for lo in range(0, len(self.n), WINDOW):
            hi = min(lo + WINDOW, len(self.n))
            # The first `weak` lists together don't exceed the score to beat.
            weak = int(np.searchsorted(below, beat, "right")) - 1
            if weak == len(lists):
                break
            total = np.zeros(hi - lo, np.int64)
            for k in lists[weak:]:
                s, e = self.start[k], self.start[k + 1]
                b = s + int(np.searchsorted(self.last[s:e], lo))
                while b < e and self.first[b] < hi:
                    d, gain = self.block(b)
                    i, j = np.searchsorted(d, (lo, hi))
                    total[d[i:j] - lo] += gain[i:j]
                    b += 1
            found = np.flatnonzero((total > 0) & (total + below[weak] > beat))
            sums = total[found]
            for j in range(weak - 1, -1, -1):
                if not len(found):
                    break
                k = lists[j]
                s, e = self.start[k], self.start[k + 1]
                at = s + np.searchsorted(self.last[s:e], found + lo)
                there = at < e
                there[there] = self.first[at[there]] <= found[there] + lo
                keep = sums + np.where(there, self.bound[np.minimum(at, e - 1)], 0) + below[j] > beat
                found, sums, at, there = found[keep], sums[keep], at[keep], there[keep]
                for b in np.unique(at[there]):
                    mine = np.flatnonzero(there & (at == b))
                    d, gain = self.block(int(b))
                    p = np.minimum(np.searchsorted(d, found[mine] + lo), len(d) - 1)
                    hit = d[p] == found[mine] + lo
                    sums[mine[hit]] += gain[p[hit]]
            better = sums > beat
            scores, docs = np.concatenate((scores, sums[better])), np.concatenate((docs, found[better] + lo))
            if len(scores) > top:
                order = np.lexsort((docs, -scores))[:top]
                scores, docs = scores[order], docs[order]
            if len(scores) >= top:
                beat = int(scores.min())
        return scores, docs


def _items(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Items as (item_id, distinct terms), in passes of bounded size."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        held.append((row["item_id"], sorted(set(terms(row["text"])))))
        size += len(row["text"] or "")
        if len(held) == ITEMS_TOGETHER or size > ITEM_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of benchmark (item_id, text) the `top` best of all docs (doc_id, text) with a score above 0.

    Texts count whole; a null text has no terms. Equal scores go by ascending doc_id, null first; rows with equal doc_id are documents each, and rows with equal
    item_id items each. Other columns aren't read. An item without terms, or whose terms no document has, gives no row. Tables may be empty.
    The index has all documents and the terms of a pass of at most ITEMS_TOGETHER items. The result is a written table."""
    spark = docs.sparkSession
    kinds = {t.schema[c].name: t.schema[c].dataType.simpleString() for t, c in ((docs.select("doc_id"), "doc_id"), (benchmark.select("item_id"), "item_id"))}
    out = None
    with scratch():
        for held in _items(benchmark):
            names = sorted({t for _, found in held for t in found})
            wanted = {t: k for k, t in enumerate(names)}
            schema = f"doc_ids array<{kinds['doc_id']}>, {_ROW}"
            arrow = pa.schema([("doc_ids", pa.list_(_arrow_type(kinds["doc_id"]))), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("body", pa.binary()), ("first", pa.binary()), *((k, pa.binary()) for k in _PARTS)])
            shipped = spark.sparkContext.broadcast(wanted)
            segments = write_shared(docs.select("doc_id", "text").mapInArrow(lambda b, s=shipped, a=arrow: _index(b, s.value, a), schema), "search-segments")
            counts = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
            n_docs, n_terms = counts[0] or 0, counts[1] or 0
            df = np.zeros(len(names), np.int64)
            pairs = segments.select("terms", "df").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
            for r in pairs.collect():  # a row for each asked term of the pass
                df[r["term"]] = r["df"]
            weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
            asked = [[wanted[t] for t in found] for _, found in held]
            plan = spark.sparkContext.broadcast((asked, weights, n_docs, n_terms))
            heaps = segments.mapInArrow(lambda b, p=plan, t=_arrow_type(kinds["doc_id"]): _search(b, *p.value, top, t), f"item int, doc_id {kinds['doc_id']}, score long")
            best = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
            ranked = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(held)], f"item int, item_id {kinds['item_id']}")
            part = write_shared(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "search-best", keep=True)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    return out


def _arrow_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def _frequencies(batches):
    for batch in batches:
        for names, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, np.int32)), pa.array(np.frombuffer(df, np.int64))], ["term", "df"])


def _search(batches, asked: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, top: int, kind: pa.DataType):
    """The best documents of a task's segments for each item: segments' heaps are merged before they leave the task."""
    held: list[list] = [[] for _ in asked]
    for batch in batches:
        for k in range(batch.num_rows):
            segment = _Segment(batch.slice(k, 1).to_pylist()[0], weights, n_docs, max(1, n_terms))
            for item, found in enumerate(asked):
                scores, docs = segment.search(found, top)
                fresh = [(-s, (segment.ids[d] is not None, segment.ids[d])) for s, d in zip(scores.tolist(), docs.tolist())]
                if fresh:
                    held[item] = heapq.nsmallest(top, held[item] + fresh)
    rows = [(item, i, -s) for item, best in enumerate(held) for s, (_, i) in best]
    if rows:
        item, ids, score = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, kind), pa.array(score, pa.int64())], ["item", "doc_id", "score"])
