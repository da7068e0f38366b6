"""Document likelihood over all subword segmentations.

The pieces of a public vocabulary form a lattice over the UTF-8 bytes of a text; the
probability of the text is the sum over all ways to cut it into pieces of the product of
their unigram probabilities. A piece never crosses white space, so a text's lattice is a
chain of word lattices and each distinct word is summed once. A training word is also an
arc over its whole lattice, of count less an absolute discount, and what is discounted is
the evidence for the pieces: their probabilities start from the vocabulary, every piece
alike, and are re-estimated by expectation maximisation, each pass a Spark job over all
distinct training words. Pieces, word arcs and the end share one unigram distribution."""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from travelfields.llm.text import words
from travelfields.shared import write_shared

EM_PASSES = 3
#: Added to each piece's expected count.
SMOOTHING = 0.1
#: Words whose scores every task holds; texts ask a join for the others.
COMMON_WORDS = 200_000
#: Longer words are never among them, so that they take a bounded number of bytes.
COMMON_BYTES = 64
#: Cells of a lattice batch. A word whose lattice has more is taken in chunks of so many bytes.
CELLS = 1 << 21
CHUNK = 1 << 14
#: Words whose least possible probability is above 10 to the minus this are summed as probabilities, others as logarithms.
PLAIN = 280.0
_P = np.uint64(0x100000001B3)


class Lattice:
    """Pieces as byte strings, with log10 probabilities. All single bytes are pieces, so every word has a segmentation."""

    def __init__(self, pieces: list[bytes]):
        pieces = sorted({*pieces, *(bytes([b]) for b in range(256))})
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces hash alike")
        self.pieces = [pieces[i] for i in order]
        self.keys = keys[order]
        self.lengths = sorted({len(p) for p in pieces})
        # Which leading bits of a hash some piece has: most spans of a text are no piece, and end there.
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.logp = np.full(len(pieces), -np.log10(len(pieces) + 1))
        self.end = self.logp[0]

    @staticmethod
    def _hash(p: bytes) -> int:
        h = 0xCBF29CE484222325
        for b in p:
            h = ((h + b + 1) * 0x100000001B3) & ((1 << 64) - 1)
        return h

    def _spans(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """length -> piece index (or -1) at each start, for words of one length."""
        n, size = codes.shape
        out, h = {}, np.full((n, size), np.uint64(0xCBF29CE484222325))
        for k in range(1, min(size, self.lengths[-1]) + 1):
            h = (h[:, : size - k + 1] + codes[:, k - 1 :] + np.uint64(1)) * _P
            if k in self.lengths:
                maybe = np.nonzero(self.some[(h >> np.uint64(44)).astype(np.int64)])
                asked = h[maybe]
                at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
                out[k] = np.full(h.shape, -1)
                out[k][maybe] = np.where(self.keys[at] == asked, at, -1)
        return out

    def _forward(self, spans: dict, n: int, size: int) -> np.ndarray:
        """alpha[:, j]: log10 of the summed probability of the first j bytes."""
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0.0
        for j in range(1, size + 1):
            terms = [alpha[:, j - k] + np.where(s[:, j - k] >= 0, self.logp[s[:, j - k]], -np.inf) for k, s in spans.items() if k <= j]
            stack = np.stack(terms)
            top = stack.max(0)
            alpha[:, j] = top + np.log10((10.0 ** (stack - top)).sum(0))
        return alpha

    def _chances(self, spans: dict, n: int, size: int, back: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The summed probabilities themselves of the first j bytes and, with back, of the bytes from j on, in rows by j."""
        p = np.append(10.0**self.logp, 0.0)
        arcs = {k: p[s.T] for k, s in spans.items() if (s >= 0).any()}
        alpha = np.zeros((size + 1, n))
        alpha[0] = 1.0
        for j in range(1, size + 1):
            for k, a in arcs.items():
                if k <= j:
                    alpha[j] += alpha[j - k] * a[j - k]
        if not back:
            return alpha, None
        beta = np.zeros((size + 1, n))
        beta[size] = 1.0
        for i in range(size - 1, -1, -1):
            for k, a in arcs.items():
                if i + k <= size:
                    beta[i] += beta[i + k] * a[i]
        return alpha, beta

    def _plain(self, size: int) -> bool:
        """Whether no product of probabilities over so many bytes leaves the range of doubles."""
        return -size * self.logp.min() < PLAIN

    def _arcs(self, codes: np.ndarray, first: int, last: int, by_end: bool) -> np.ndarray:
        """One row for each of the positions first..last-1, one column for each piece length: the piece that starts there or, by_end, ends behind it; else -1."""
        most = self.lengths[-1]
        at = max(0, first + 1 - most) if by_end else first
        part = codes[at : last if by_end else last + most - 1]
        out = np.full((last - first, len(self.lengths)), -1)
        for k, s in self._spans(part[None, :]).items():
            row = np.arange(s.shape[1]) + at - first + (k - 1 if by_end else 0)
            here = (row >= 0) & (row < last - first)
            out[row[here], self.lengths.index(k)] = s[0, here]
        return out

    def _ring(self, arcs: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The recursion over the rows of arcs, in their order. edge: the values of as many positions before the first row as the longest piece
        has bytes, the next one last. Returns edge and the new values."""
        most, back = self.lengths[-1], np.array(self.lengths)
        value = np.concatenate([edge, np.empty(len(arcs))])
        logp = np.where(arcs >= 0, self.logp[arcs], -np.inf)
        for r in range(len(arcs)):
            term = logp[r] + value[most + r - back]
            top = term.max()
            value[most + r] = top + np.log10((10.0 ** (term - top)).sum()) if top > -np.inf else -np.inf
        return value

    def _edge(self) -> np.ndarray:
        return np.concatenate([np.full(self.lengths[-1] - 1, -np.inf), [0.0]])

    def _long(self, codes: np.ndarray, weight: float | None = None) -> tuple[float, np.ndarray | None]:
        """(log10 probability of one word, expected uses of pieces if there is a weight) in memory that grows by an edge a chunk. The way back
        computes each chunk's forward values again from the edge before it."""
        most, size = self.lengths[-1], len(codes)
        starts, edges = range(0, size, CHUNK), [self._edge()]
        for lo in starts:
            edges.append(self._ring(self._arcs(codes, lo, min(lo + CHUNK, size), True), edges[-1])[-most:])
        z = float(edges[-1][-1])
        if weight is None:
            return z, None
        total, behind = np.zeros(len(self.keys)), self._edge()
        for lo, edge in reversed(list(zip(starts, edges))):
            hi = min(lo + CHUNK, size)
            alpha = self._ring(self._arcs(codes, lo, hi, True), edge)[most - 1 : -1]
            arcs = self._arcs(codes, lo, hi, False)
            # Reversed, the value of position i stands behind those of i + 1, i + 2 and so on.
            beta = self._ring(arcs[::-1], behind)
            row, col = np.nonzero(arcs >= 0)
            piece = arcs[row, col]
            post = 10.0 ** (alpha[row] + self.logp[piece] + beta[most + (hi - lo - 1 - row) - np.array(self.lengths)[col]] - z)
            total += np.bincount(piece, post * weight, len(total))
            behind = beta[-most:]
        return z, total

    def _batches(self, ws: list[str], long: list):
        """Batches of words of one size; words that are too long for a batch go to long, as (row, codes)."""
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(raw := [b" " + w.encode("utf-8", "surrogatepass") for w in ws]):
            if len(w) * min(len(w), self.lengths[-1]) > CELLS:
                long.append((i, np.frombuffer(w, np.uint8).astype(np.uint64)))
            else:
                by_size.setdefault(len(w), []).append(i)
        for size, rows in by_size.items():
            step = max(1, CELLS // (size * min(size, self.lengths[-1])))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                codes = np.frombuffer(b"".join(raw[i] for i in part), np.uint8).reshape(len(part), size).astype(np.uint64)
                yield part, codes, size

    def score(self, ws: list[str]) -> np.ndarray:
        """log10 marginal probability of each word, with the space before it."""
        out, long = np.zeros(len(ws)), []
        for rows, codes, size in self._batches(ws, long):
            spans = self._spans(codes)
            out[rows] = np.log10(self._chances(spans, len(rows), size)[0][size]) if self._plain(size) else self._forward(spans, len(rows), size)[:, size]
        for i, codes in long:
            out[i] = self._long(codes)[0]
        return out

    def expected(self, ws: list[str], weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over weighted words."""
        total, long = np.zeros(len(self.keys)), []
        for rows, codes, size in self._batches(ws, long):
            n = len(rows)
            spans = self._spans(codes)
            if self._plain(size):
                alpha, beta = self._chances(spans, n, size, back=True)
                share = weight[rows] / alpha[size]
                for k, s in spans.items():
                    r, i = np.nonzero(s >= 0)
                    piece = s[r, i]
                    total += np.bincount(piece, alpha[i, r] * 10.0 ** self.logp[piece] * beta[i + k, r] * share[r], len(total))
                continue
            alpha = self._forward(spans, n, size)
            beta = np.full((n, size + 1), -np.inf)
            beta[:, size] = 0.0
            for i in range(size - 1, -1, -1):
                stack = np.stack([beta[:, i + k] + np.where(s[:, i] >= 0, self.logp[s[:, i]], -np.inf) for k, s in spans.items() if i + k <= size])
                top = stack.max(0)
                safe = np.where(np.isfinite(top), top, 0.0)
                with np.errstate(divide="ignore"):
                    beta[:, i] = safe + np.log10((10.0 ** (stack - safe)).sum(0))
            z = alpha[:, size]
            w = weight[rows]
            for k, s in spans.items():
                r, i = np.nonzero(s >= 0)
                piece = s[r, i]
                post = 10.0 ** (alpha[r, i] + self.logp[piece] + beta[r, i + k] - z[r])
                total += np.bincount(piece, post * w[r], len(total))
        for i, codes in long:
            total += self._long(codes, weight[i])[1]
        return total


def read_pieces(path: str) -> list[bytes]:
    """Byte strings of a vocabulary of base64 and rank lines; those with A-Z, or with white space but as a first blank, cannot occur."""
    with open(path, "rb") as f:
        found = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    bad = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r")
    return [p for p in found if len(p) == 1 or not (bad & set(p) or b" " in p[1:])]


def _count(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            train, every = Counter(), set()
            for t, held in zip(batch.column("text").slice(at, 2048), batch.column("held_out").slice(at, 2048)):
                ws = words(t.as_py())
                if held.as_py():
                    every.update(ws)
                else:
                    train.update(ws)
            every.difference_update(train)
            ws = [*train, *every]
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([*train.values(), *([0] * len(every))], pa.int64())], ["word", "c"])


def _expect(model, discount: float):
    def run(batches):
        lattice: Lattice = model.value
        total = np.zeros(len(lattice.keys))
        for b in batches:
            total += lattice.expected(b.column("word").to_pylist(), np.minimum(b.column("c").to_numpy(), discount))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    return run


def _score_words(model, discount: float, total: float):
    def run(batches):
        for b in batches:
            arc = np.maximum(b.column("c").to_numpy() - discount, 0.0) / total
            cut = model.value.score(b.column("word").to_pylist())
            with np.errstate(divide="ignore"):
                lp = np.logaddexp(np.log(arc), cut * np.log(10)) / np.log(10)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(lp)], ["word", "c", "lp"])

    return run


_DOC = "row long, doc_id long, held_out boolean, n_words long, known long, base double, score double, rare array<string>, rare_n array<long>"


def _score_texts(common, n_all: int, n_types: int):
    def run(batches):
        ws0, c0, lp0 = common.value
        index = {w: k for k, w in enumerate(ws0)}
        base0 = np.log10((c0 + 0.1) / (n_all + 0.1 * (n_types + 1)))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                out: list[list] = [[] for _ in range(9)]
                for doc, held, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text")):
                    ws = words(t.as_py())
                    k = np.fromiter((index.get(w, -1) for w in ws), np.int64, len(ws))
                    hit = k[k >= 0]
                    rare = Counter(w for w, i in zip(ws, k) if i < 0) if len(hit) < len(ws) else {}
                    for o, v in zip(out, (row, doc, held, len(ws), int((c0[hit] > 0).sum()), float(base0[hit].sum()), float(lp0[hit].sum()), list(rare), list(rare.values()))):
                        o.append(v)
                    row += 1
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(o, kind) for o, kind in zip(out, kinds)], ["row", "doc_id", "held_out", "n_words", "known", "base", "score", "rare", "rare_n"])

    return run


def score_documents(documents: DataFrame, vocabulary_path: str, held_out: Column, passes: int = EM_PASSES) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Rows where held_out is false train. base_score is the smoothed unigram of whole words: the sum over tokens
    (words and one end) of log10((c + 0.1) / (N + 0.1 * (V + 1))). score is log10 of the lattice's marginal
    probability of the words and the end. The discount is n1 / (n1 + 2 * n2), from words that occur once and twice. Words are runs of [^\\x20\\x09-\\x0D] with A-Z folded. A null text is empty:
    its only token is the end. Repeated rows are counted and scored each. Without training rows N = V = 0,
    and pieces are all alike. Other columns are ignored. Empty input: no rows.

    Counts and expected counts cover all training words. What is broadcast is bounded by the vocabulary and by
    COMMON_WORDS; a rarer word is looked up by a join on the word. A word of any length is summed in chunks
    of bounded memory."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    sc = documents.sparkSession.sparkContext
    counted = docs.mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = write_shared(counted, "lm-words")
    n_words, n_types, once, twice = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n_ends = docs.where("not held_out").count()
    n_all, n_types = n_words + n_ends, n_types + (1 if n_ends else 0)

    discount = (once + 1) / (once + 2 * twice + 2)
    lattice, total = Lattice(read_pieces(vocabulary_path)), 1.0
    whole = counts.where("c > 0").agg(F.sum(F.greatest(F.lit(0.0), F.col("c") - discount))).first()[0] or 0.0
    for _ in range(passes if n_all else 0):
        sums = counts.where("c > 0").mapInArrow(_expect(sc.broadcast(lattice), discount), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(len(lattice.keys), SMOOTHING)
        n[sums["piece"].to_numpy(int)] += sums["n"].to_numpy(float)
        total = float(n.sum() + whole + n_ends + SMOOTHING)
        lattice.logp, lattice.end = np.log10(n / total), float(np.log10((n_ends + SMOOTHING) / total))
    scored = write_shared(counts.mapInArrow(_score_words(sc.broadcast(lattice), discount, total), "word string, c long, lp double"), "lm-scored")

    top = scored.where(F.octet_length("word") <= COMMON_BYTES).orderBy(F.desc("c"), "word").limit(COMMON_WORDS).toPandas()
    common = sc.broadcast((top["word"].tolist(), top["c"].to_numpy(float), top["lp"].to_numpy(float)))
    texts = write_shared(docs.mapInArrow(_score_texts(common, n_all, n_types), _DOC), "lm-texts")
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("e")).select("row", F.col("e.rare").alias("word"), F.col("e.rare_n").alias("k"))
    floor = float(n_all + 0.1 * (n_types + 1))
    base = lambda c: F.log10((c + 0.1) / floor)
    found = rare.join(scored, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * base(F.col("c"))).alias("more_base"), F.sum(F.col("k") * F.col("lp")).alias("more_score")
    )
    more = lambda c: F.coalesce(c, F.lit(0))
    return texts.join(found, "row", "left").select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + more("more_known") + (1 if n_ends else 0)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base") + base(F.lit(float(n_ends)))).alias("base_score"), (F.col("score") + more("more_score") + lattice.end).alias("score"),
    )
