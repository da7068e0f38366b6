"""Language identification by prediction by partial matching.

Each language has a context tree of bytes: a node is a context of up to ORDER bytes and holds the counts of the bytes that followed it
in the texts learned from. A byte is coded at the longest context that the tree knows, by its count; a byte that didn't follow there
costs an escape (method C: as likely as the context has distinct successors) and is coded one byte shorter, without the bytes that the longer context
would have coded. Below the empty context all bytes left are equally likely. Counts are frozen after learning, so a code length depends
on the last ORDER + 1 bytes alone and is exact: lengths are whole numbers of 2^-16 bits, whose sum doesn't depend on any order.

Counts are taken over all texts learned from, in one pass with a combine in each task, and nothing is pruned. Successors of a context of two bytes or more stand in one bucket, where
the code lengths of all grams in the texts are worked out. Those of the NODES most frequent grams go to every task; the others are joined, so each is exact. More than LANGUAGES
languages are further passes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from travelfields.llm.text import row_hash
from travelfields.operators.indexing import dense_index
from travelfields.shared import scratch, write_shared

#: Bytes of the longest context; a context and its next byte fit a long.
ORDER = 4
#: Grams at most whose code lengths go to every task, the most frequent ones, by the least power of two of their counts that fits; others are joined.
NODES = 1 << 18
#: Languages of one pass, those with the most texts first; ties go to the lower name.
LANGUAGES = 64
#: Counts in a bucket of contexts, on average.
BUCKET = 200_000
#: Bytes that are turned into numbers at once.
CHUNK = 1 << 20
#: Distinct contexts that a task counts before it hands them on.
HELD = 1 << 21
UNKNOWN = "und"
_UNIT = 65536.0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = [(1 << (8 * k)) - 1 for k in range(ORDER + 2)]


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(gram of each byte, first gram of each text) for texts data[start:end], in chunks of at most CHUNK bytes or one text's part; yields
    (texts, grams, offsets). A gram is a byte behind the ORDER bytes before it; zeros stand before a text."""
    k, n = 0, len(starts)
    while k < n:
        if ends[k] - starts[k] > CHUNK:
            for at in range(int(starts[k]), int(ends[k]), CHUNK):
                lead = min(ORDER, at - int(starts[k]))
                part = np.concatenate((np.zeros(ORDER - lead, np.uint8), _FOLD[data[at - lead : min(at + CHUNK, int(ends[k]))]]))
                yield np.array([k]), _codes(part)[ORDER:], np.array([0])
            k += 1
            continue
        size = np.cumsum(ends[k:] - starts[k:])
        m = max(1, int(np.searchsorted(size, CHUNK, "right")))
        texts = np.arange(k, k + m)
        lengths = (ends[k : k + m] - starts[k : k + m]).astype(np.int64)
        k += m
        texts, lengths = texts[lengths > 0], lengths[lengths > 0]
        if not len(texts):
            continue
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
        to = np.arange(offsets[-1]) + ORDER * (1 + np.repeat(np.arange(len(texts)), lengths))
        padded = np.zeros(offsets[-1] + ORDER * len(texts), np.uint8)
        padded[to] = _FOLD[data[np.repeat(starts[texts], lengths) + inside]]
        yield texts, _codes(padded)[to], offsets[:-1]


def _codes(padded: np.ndarray) -> np.ndarray:
    code = padded.astype(np.int64)
    out = code.copy()
    for back in range(1, ORDER + 1):
        out[back:] |= code[:-back] << (8 * back)
    return out


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each text starts and ends; nulls are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams = np.concatenate([g for g, _ in held])
    counts = np.concatenate([c for _, c in held])
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, int)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches):
    """Arrow batches (lang, text) to (lang, gram, n), combined in memory of bounded size. Texts that aren't learned from have no lang."""
    held: dict[str, list] = {}

    def emit():
        for lang in sorted(held, key=lambda x: (x is not None, x)):
            grams, counts = _merge(held[lang])
            for at in range(0, len(grams), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams[part]), pa.string()), pa.array(grams[part]), pa.array(counts[part])], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        data, starts, ends = _bytes_of(batch.column("text"))
        for lang in dict.fromkeys(langs):
            rows = np.flatnonzero(langs == lang)
            for _, grams, _ in _grams(data, starts[rows], ends[rows]):
                held.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                if len(held[lang]) > 8:
                    held[lang] = [_merge(held[lang])]
            if sum(len(g) for parts in held.values() for g, _ in parts) > HELD:
                for other in held:
                    held[other] = [_merge(held[other])]
                if sum(len(parts[0][0]) for parts in held.values()) > HELD // 2:
                    yield from emit()
    yield from emit()


class ContextTree:
    """Frozen counts of one language: for each depth the contexts and their successors as sorted numbers. With short, the pairs of bytes of the
    whole language and their counts, grams may be those of some contexts of two bytes alone."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray] | None = None):
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order].astype(np.int64)
        self.grams, self.counts, self.ctx, self.total, self.kinds = {}, {}, {}, {}, {}
        for depth in range(ORDER, -1, -1):
            all_grams, n = short if short and depth < 2 else (grams, counts)
            self.grams[depth], self.counts[depth] = _merge([(all_grams & _MASK[depth + 1], n)])
            self.ctx[depth], first = np.unique(self.grams[depth] >> 8, return_index=True)
            self.total[depth] = np.add.reduceat(self.counts[depth], first) if len(first) else first
            self.kinds[depth] = np.diff(np.append(first, len(self.grams[depth])))
        # Of the context one byte shorter: what its successors weigh without those of the longer one, and how many they are.
        self.rest, self.rest_kinds = {}, {}
        for depth in range(1, ORDER + 1):
            g = self.grams[depth]
            below = self.counts[depth - 1][np.searchsorted(self.grams[depth - 1], g & _MASK[depth])]
            of = np.searchsorted(self.ctx[depth], g >> 8)
            taken = np.bincount(of, weights=below, minlength=len(self.ctx[depth])).astype(np.int64)
            up = np.searchsorted(self.ctx[depth - 1], self.ctx[depth] & _MASK[depth - 1])
            self.rest[depth] = self.total[depth - 1][up] - taken
            self.rest_kinds[depth] = self.kinds[depth - 1][up] - self.kinds[depth]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte, in 2^-16 bits."""
        cost = np.zeros(len(grams))
        left = np.arange(len(grams))
        longer = np.full(len(grams), -1)  # where the context one byte longer stands, -1 if the tree doesn't have it
        for depth in range(ORDER, -1, -1):
            if not len(left) or not len(self.ctx[depth]):
                continue
            g, up = grams[left], longer[left]
            ctx = (g >> 8) & _MASK[depth]
            at = np.minimum(np.searchsorted(self.ctx[depth], ctx), len(self.ctx[depth]) - 1)
            known = self.ctx[depth][at] == ctx
            weight, kinds = self.total[depth][at], self.kinds[depth][at]
            if depth < ORDER and len(self.ctx[depth + 1]):
                weight = np.where(up >= 0, self.rest[depth + 1][np.maximum(up, 0)], weight)
                kinds = np.where(up >= 0, self.rest_kinds[depth + 1][np.maximum(up, 0)], kinds)
            codes = known & (kinds > 0)
            own = g & _MASK[depth + 1]
            to = np.minimum(np.searchsorted(self.grams[depth], own), len(self.grams[depth]) - 1)
            found = codes & (self.grams[depth][to] == own)
            share = np.where(found, self.counts[depth][to], kinds)
            cost[left[codes]] += np.log2((weight + kinds)[codes] / share[codes])
            longer[left] = np.where(known, at, -1)
            left = left[~found]
        cost[left] += np.log2(max(1, 256 - len(self.grams[0])))
        return np.rint(cost * _UNIT).astype(np.int32)


class CodeTable:
    """Code lengths (grams, languages) of known grams, by hash."""

    def __init__(self, known: np.ndarray, cost: np.ndarray):
        self.known, self.cost = known, cost
        self.shift = 64 - max(8, int(len(self.known)).bit_length() + 2)
        self.slots = np.full(1 << (64 - self.shift), -1, np.int32)
        left, step = np.arange(len(self.known)), 0
        while len(left):
            slot = self._slot(self.known[left], step)
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free[::-1]]] = left[free[::-1]]
            left, step = left[self.slots[slot] != left], step + 1

    def _slot(self, grams: np.ndarray, step: int) -> np.ndarray:
        mixed = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)
        return (mixed.astype(np.int64) + step) & (len(self.slots) - 1)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Where each gram is in known, -1 if it isn't."""
        at = np.full(len(grams), -1, np.int32)
        left, step = np.arange(len(grams)), 0
        asked = grams
        while len(left):
            got = self.slots[self._slot(asked, step)]
            hit = (got >= 0) & (self.known[got] == asked)
            at[left[hit]] = got[hit]
            go = (got >= 0) & ~hit
            left, asked, step = left[go], asked[go], step + 1
        return at


class LanguageModel:
    """Trees of all languages, and the code lengths of all grams that any of them knows in one table."""

    def __init__(self, trees: dict[str, ContextTree], texts: dict[str, int]):
        self.langs, self.trees = sorted(trees), trees
        self.prior = prior_bits([texts[x] for x in self.langs], sum(texts.values()))
        known = np.unique(np.concatenate([trees[x].grams[ORDER] for x in self.langs])) if trees else np.zeros(0, np.int64)
        self.table = CodeTable(known, self._bits(known))

    def _bits(self, grams: np.ndarray) -> np.ndarray:
        return np.stack([self.trees[x].bits(grams) for x in self.langs], 1)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """(grams, languages) code lengths."""
        if not len(self.table.known):
            return self._bits(grams)
        at = self.table.find(grams)
        out = self.table.cost[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            kinds, back = np.unique(grams[new], return_inverse=True)
            out[new] = self._bits(kinds)[back]
        return out


def prior_bits(texts: list[int], total: int) -> np.ndarray:
    """Code length of each language's name, in 2^-16 bits."""
    return np.array([round(-np.log2(n / total) * _UNIT) for n in texts], np.int64)


def _write_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lang, gram, n) of all texts, lang null where they aren't learned from; (gram, uses) over all), written tables."""
    text = F.coalesce("text", F.lit("")).alias("text")
    counted = rows.select(F.when(~F.col("held_out"), F.col("lang")).alias("lang"), text).mapInArrow(_count, "lang string, gram long, n long")
    counted = write_shared(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ppm-counts")
    return counted, write_shared(counted.groupBy("gram").agg(F.sum("n").alias("uses")), "ppm-grams")


def _code_lengths(counted: DataFrame, grams: DataFrame, langs: list[str]) -> DataFrame:
    """(gram, uses, bits array<int>) of all grams, by langs, a written table. A bucket holds all counts behind some contexts of two bytes; of shorter contexts
    every bucket has all counts, 65,536 a language at most."""
    spark = counted.sparkSession
    codes = spark.createDataFrame([(x, k) for k, x in enumerate(langs)], "lang string, code int")
    learned = counted.join(F.broadcast(codes), "lang").select("code", "gram", "n")
    pairs = learned.groupBy("code", F.col("gram").bitwiseAND(_MASK[2]).alias("gram")).agg(F.sum("n").alias("n")).toPandas()
    short = []
    for k in range(len(langs)):
        mine = pairs[pairs["code"] == k]
        short.append((mine["gram"].to_numpy(np.int64), mine["n"].to_numpy(np.int64)))
    shipped = spark.sparkContext.broadcast(short)

    def lengths(table: pa.Table) -> pa.Table:
        code, gram, n = (table.column(c).to_numpy() for c in ("code", "gram", "n"))
        asked = code < 0
        wanted = gram[asked]
        out = np.stack([ContextTree(gram[code == k], n[code == k], pair).bits(wanted) for k, pair in enumerate(shipped.value)], 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(wanted) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
        return pa.table({"gram": wanted, "uses": n[asked], "bits": lists})

    both = learned.unionByName(grams.select(F.lit(-1).alias("code"), "gram", F.col("uses").alias("n")))
    buckets = min(1 << 16, max(16, both.count() // BUCKET))
    bucket = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(_MASK[2])), F.lit(buckets)).alias("bucket")
    return write_shared(both.select("code", "gram", "n", bucket).groupBy("bucket").applyInArrow(lengths, "gram long, uses long, bits array<int>"), "ppm-bits")


def _frequent(lengths: DataFrame, languages: int) -> tuple[CodeTable, int]:
    """The table of at most NODES grams that goes to every task, and the number of uses that those grams have at least."""
    sizes = {r["b"]: r["k"] for r in lengths.groupBy(F.floor(F.log2("uses")).alias("b")).agg(F.count("*").alias("k")).collect()}
    kept, least = 0, 0
    for b in sorted(sizes, reverse=True):
        kept += sizes[b]
        if kept > NODES:
            least = b + 1
            break
    table = lengths.where(F.col("uses") >= 2**least).select("gram", "bits").toArrow()
    lists = table.column("bits").combine_chunks()
    values = lists.flatten().to_numpy().reshape(-1, languages) if len(lists) else np.zeros((0, languages), np.int32)
    return CodeTable(table.column("gram").to_numpy(), values), least


def _decide(batches, langs: list[str], prior: np.ndarray):
    """Adds the two parts of each row's code lengths: (lang, least, weight), weight being the sum of the languages' shares over that of the best."""
    for batch in batches:
        total = np.tile(prior, (len(batch), 1))
        for name in ("totals", "more"):
            lists = batch.column(name)
            filled = lists.is_valid().to_numpy(zero_copy_only=False)
            if filled.any():
                total[filled] += lists.drop_null().flatten().to_numpy().reshape(-1, len(langs))
        best = total.argmin(1)  # the lowest name of equals
        least = total[np.arange(len(best)), best]
        weight = np.exp2(-np.minimum((total - least[:, None]) / _UNIT, 1000)).sum(1)
        names = pa.array([langs[k] for k in best], pa.string())
        own = [batch.column(c) for c in _ROW]
        yield pa.RecordBatch.from_arrays([*own, names, pa.array(least), pa.array(weight)], [*_ROW, "lang", "least", "weight"])


_ROW = ["id", "doc_id", "held_out", "has_letter", "h1", "h2"]


def _score(asked: DataFrame, lengths: DataFrame, langs: list[str], prior: np.ndarray, kind: str) -> DataFrame:
    """(id, doc_id, held_out, has_letter, h1, h2, lang, least, weight) of each row of asked, by langs. Frequent grams are summed where the text is; the others meet their code lengths in a join."""
    frequent, least = _frequent(lengths, len(langs))
    shipped = lengths.sparkSession.sparkContext.broadcast(frequent)
    columns = [*_ROW, "totals", "gram", "k"]
    types = f"id long, doc_id {kind}, held_out boolean, has_letter boolean, h1 long, h2 long"

    def read(batches):
        table = shipped.value
        for batch in batches:
            data, starts, ends = _bytes_of(batch.column("text"))
            ids = batch.column("id").to_numpy()
            total = np.zeros((len(starts), len(langs)), np.int64)
            for texts, grams, offsets in _grams(data, starts, ends):
                at = table.find(grams) if len(table.known) else np.full(len(grams), -1)
                rare = np.flatnonzero(at < 0)
                if len(table.known):
                    bits = table.cost[at]
                    bits[rare] = 0
                    total[texts] += np.add.reduceat(bits, offsets, axis=0, dtype=np.int64)
                if len(rare):
                    of = np.searchsorted(offsets, rare, "right") - 1
                    order = np.lexsort((grams[rare], of))
                    of, gram = of[order], grams[rare][order]
                    first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (gram[1:] != gram[:-1]))))
                    k = np.diff(np.append(first, len(gram)))
                    nothing = [pa.nulls(len(first), batch.column(c).type) for c in _ROW[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[texts[of[first]]]), *nothing, pa.nulls(len(first), pa.list_(pa.int64())), pa.array(gram[first]), pa.array(k.astype(np.int64))], columns)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(langs)), pa.array(total.ravel()))
            own = [batch.column(c) for c in _ROW]
            yield pa.RecordBatch.from_arrays([*own, lists, pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64())], columns)

    found = write_shared(asked.mapInArrow(read, f"{types}, totals array<long>, gram long, k long"), "ppm-read")
    heads, rest = found.where("gram is null").drop("gram", "k"), found.where("gram is not null").select("id", "gram", "k")
    met = rest.join(lengths.where(F.col("uses") < 2**least), "gram")
    sums = met.groupBy("id").agg(F.array(*(F.sum(F.col("k") * F.col("bits")[j]) for j in range(len(langs)))).alias("more"))
    both = heads.withColumn("more", F.lit(None).cast("array<long>")) if rest.isEmpty() else heads.join(sums, "id", "left")
    return both.mapInArrow(lambda batches: _decide(batches, langs, prior), f"{types}, lang string, least long, weight double")


def _best_of(passes: list[DataFrame]) -> DataFrame:
    """The first pass's rows with the best language over all passes, which meet on the hash of the text."""
    if len(passes) == 1:
        return passes[0]
    every = passes[0]
    for other in passes[1:]:
        every = every.unionByName(other)
    every = every.select("h1", "h2", "lang", "least", "weight").distinct()
    found = every.groupBy("h1", "h2").agg(F.min(F.struct("least", "lang")).alias("best"), F.collect_list(F.struct("least", "weight")).alias("of"))
    part = lambda acc, x: acc + x["weight"] * F.pow(F.lit(2.0), -F.least(F.lit(1000.0), (x["least"] - F.col("best.least")) / _UNIT))
    found = found.select("h1", "h2", "best.lang", "best.least", F.aggregate("of", F.lit(0.0), part).alias("weight"))
    return passes[0].drop("lang", "least", "weight").join(found, ["h1", "h2"])


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits) for each row of docs (doc_id, text, lang); other columns aren't read.

    Rows that aren't held out and have a lang are learned from, over their whole text; the prediction reads the text alone. A-Z count as a-z. lang_pred is the language
    with the shortest code of its name (by its share of texts) and of the text; equal lengths go to the lower name. score is that language's
    share of the probability, 0 to 1. Texts that are null, empty or without a letter are `und` with score 0, and so are all if
    nothing can be learned. Repeated rows are each a row of the result; an empty table gives an empty one."""
    rows = docs.select("doc_id", "lang", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    has_letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("has_letter")
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    with scratch():
        named = rows.where("not held_out and lang is not null").groupBy("lang").agg(F.count("*").alias("texts"))
        ranked = named.withColumn("key", F.concat(F.lpad((F.lit(2**62) - F.col("texts")).cast("string"), 19, "0"), "lang"))
        ranked = write_shared(dense_index(ranked, "key", "place").select("lang", "texts", F.floor(F.col("place") / LANGUAGES).alias("pass")), "ppm-languages")
        size = ranked.agg(F.sum("texts"), F.max("pass")).first()
        if size[0] is None:
            return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
        counted, grams = _write_counts(rows)
        whole = F.coalesce("text", F.lit("")).alias("text")
        asked = rows.select(F.monotonically_increasing_id().alias("id"), "doc_id", "held_out", whole, has_letter, *(row_hash(whole) if size[1] else (F.lit(0).cast("long").alias(h) for h in ("h1", "h2"))))
        passes = []
        for k in range(size[1] + 1):
            names = sorted((r["lang"], r["texts"]) for r in ranked.where(F.col("pass") == k).collect())
            langs = [x for x, _ in names]
            lengths = _code_lengths(counted, grams, langs)
            passes.append(write_shared(_score(asked, lengths, langs, prior_bits([n for _, n in names], size[0]), kind), "ppm-scored"))
        best = write_shared(_best_of(passes), "ppm-best", keep=True)
    of = lambda there, other: F.when(F.col("has_letter"), there).otherwise(F.lit(other))
    return best.select("doc_id", "held_out", of(F.col("lang"), UNKNOWN).alias("lang_pred"), of(1 / F.col("weight"), 0.0).alias("score"), of(F.col("least") / _UNIT, 0.0).alias("bits"))
