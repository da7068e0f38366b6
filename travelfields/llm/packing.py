"""Bounded-space online packing of token sequences into fixed windows."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from travelfields.shared import drop_shared, write_shared

WINDOW = 4096
OPEN_WINDOWS = 32
END_ID = 2
#: A window with less room than this is emitted as it is; with more, the next document is cut to fill it.
SLACK = 32
#: Partitions whose leftover windows are merged together, round by round.
FAN_IN = 16
#: Words that a Python worker remembers with their ids; beyond it those met in one chunk only are forgotten.
CACHE_WORDS = 400_000
#: Bytes of texts that are split into words at a time.
CHUNK_CHARS = 1 << 21
SPECIAL = "<|endoftext|>"
SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
CONTROL_SPACE = re.compile("[\\x1c-\\x1f]")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_known: dict[str, KnownWords] = {}


def split_words(text: str) -> list[str]:
    """Cut at the white space that the tokenizer folds, so that ids of words concatenate to ids of the text."""
    return [w for w in SPACE.split(text) if w] if CONTROL_SPACE.search(text) else text.split()


class KnownWords:
    """Ids of words in one flat array, with where each word's begin and how many they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words, self.used = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.first, self.count, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def forget(self) -> None:
        """Keep words met in two chunks or more since the last time, at most half of CACHE_WORDS: those met most."""
        keep = np.flatnonzero(self.used >= 2)
        if len(keep) > CACHE_WORDS // 2:
            keep = keep[np.argsort(-self.used[keep], kind="stable")[: CACHE_WORDS // 2]]
        count = self.count[keep]
        first = np.cumsum(count, dtype=np.int32) - count
        self.ids = self.ids[np.repeat(self.first[keep] - first, count) + np.arange(count.sum(), dtype=np.int32)]
        self.words, self.first, self.count, self.used = self.words.take(pa.array(keep)), first, count, np.ones(len(keep), np.int32)

    def learn(self, unknown: list[str]) -> None:
        """Encode words, many joined by the special token, which marks their ends; words that look like it go alone."""
        tok = self.tok
        end = tok.token_to_id(SPECIAL)
        counts, found = [], []
        odd = [k for k, w in enumerate(unknown) if end is None or "<|" in w or "|>" in w]
        alone = set(odd)
        at = 0
        for stop in [*odd, len(unknown)]:
            lines = [unknown[j : min(j + 100, stop)] for j in range(at, stop, 100)]
            for e in tok.encode_batch_fast([SPECIAL.join(line) for line in lines], add_special_tokens=False) if lines else []:
                ids = np.array(e.ids, np.uint32)
                cut = np.concatenate(([-1], np.flatnonzero(ids == end), [len(ids)]))
                found.append(ids[ids != end])
                counts.append(np.diff(cut) - 1)
            if stop in alone:
                found.append(np.array(tok.encode(unknown[stop], add_special_tokens=False).ids, np.uint32))
                counts.append(np.array([len(found[-1])]))
            at = stop + 1
        count = np.concatenate(counts).astype(np.int32)
        self.words = pa.concat_arrays([self.words, pa.array(unknown, pa.string())])
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(count, dtype=np.int32) - count))
        self.count = np.concatenate((self.count, count))
        self.used = np.concatenate((self.used, np.zeros(len(count), np.int32)))
        self.ids = np.concatenate((self.ids, *found))

    def numbers(self, words: pa.Array) -> np.ndarray:
        if len(self.words) > CACHE_WORDS:
            self.forget()
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        if len(new):
            at = at.copy()
            at[new] = len(self.words) + np.arange(len(new), dtype=np.int32)
            self.learn(words.take(pa.array(new)).to_pylist())
        self.used[at] += 1
        return at


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Lists of words, for at most CHUNK_CHARS bytes of texts at a time or one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    odd = pc.match_substring_regex(texts, "[\\x1c-\\x1f]").to_numpy(zero_copy_only=False).astype(bool)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_CHARS, "right")))
        if odd[at]:
            yield pa.array([split_words(texts[at].as_py())], pa.list_(pa.string()))
            at += 1
            continue
        rare = np.flatnonzero(odd[at:to])
        to = at + int(rare[0]) if len(rare) else to
        yield pc.utf8_split_whitespace(texts.slice(at, to - at))
        at = to


def encode(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text, in columns: words are cut and told apart by Arrow, only words not seen before meet the tokenizer,
    and ids are gathered by word number. What is known of words lives as long as the Python worker."""
    if path not in _known:
        _known[path] = KnownWords(path)
    known = _known[path]
    for lists in _chunks(texts):
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        word = known.numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int32)
        n = known.count[word]
        ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)))
        place = np.repeat(known.first[word] - ends[:-1], n)
        place += np.arange(len(place), dtype=np.int32)
        ids = known.ids[place]
        for a, b in zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist()):
            yield ids[a:b]


class Packer:
    """At most `open_windows` windows that still have room. add() places a piece best-fit; where none
    fits it closes the fullest and opens another."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.most, self.next_id = window, open_windows, first_id
        self.room: list[tuple[int, int]] = []  # (room, sequence), ascending
        self.held: dict[int, list] = {}

    def fullest_room(self) -> int:
        """Room of the fullest window if another could not be opened, else 0."""
        return self.room[0][0] if len(self.room) >= self.most else 0

    def largest_room(self) -> int:
        return self.room[-1][0] if self.room else 0

    def add(self, piece: tuple, length: int) -> Iterator[list]:
        """Yields the pieces of windows that are closed, each with sequence_id and offset."""
        at = bisect_left(self.room, (length, -1))
        if at == len(self.room):
            if len(self.room) >= self.most:
                yield self.held.pop(self.room.pop(0)[1])
            self.held[self.next_id] = []
            room, seq = self.window, self.next_id
            self.next_id += 1
        else:
            room, seq = self.room.pop(at)
        self.held[seq].append((*piece, seq, self.window - room))
        if room == length:
            yield self.held.pop(seq)
        else:
            insort(self.room, (room - length, seq))

    def close_but(self, most: int) -> Iterator[list]:
        """Close the fullest windows until at most `most` are open."""
        while len(self.room) > most:
            yield self.held.pop(self.room.pop(0)[1])

    def leftovers(self) -> list[list]:
        return list(self.held.values())


def _batch(rows: list[tuple], left: bool, schema: pa.Schema) -> pa.RecordBatch:
    cols = [np.array(c, dtype=np.int64) for c in zip(*rows)] or [np.zeros(0, np.int64)] * 7
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array([left] * len(rows)), pa.array([part] * len(rows), pa.int64())], schema=schema)


_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("left_over", pa.bool_()), ("part", pa.int64())])
_OUT_DDL = f"{PIECES}, left_over boolean, part long"
NULL_ID = -(2**63)


def _pack_texts(path: str, window: int, open_windows: int, end_id: int):
    def run(batches):
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << 36)
        for batch in batches:
            done: list[tuple] = []
            names = batch.column(0).fill_null(NULL_ID).to_pylist()
            for doc, found in zip(names, encode(batch.column(1).fill_null(""), path)):
                ids = found.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                total, start = len(ids) // 4, 0
                while start < total:
                    take = min(window, total - start)
                    room = packer.fullest_room()
                    if SLACK <= room < take and packer.largest_room() < take:
                        take = room  # nothing else fits: cut the document to close the fullest without padding
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + take)])
                    for closed in packer.add((doc, start, take, crc, total), take):
                        done += closed
                    start += take
            if done:
                yield _batch(done, False, _OUT)
        rest = [p for w in packer.leftovers() for p in w]
        if rest:
            yield _batch(rest, True, _OUT)

    return run


def _merge(window: int, open_windows: int, shift: int):
    """Place the pieces of leftover windows anew, largest first, with room for all windows of a group; of those
    still open at the end the open_windows emptiest are left over again."""

    def run(batches):
        part = TaskContext.get().partitionId()
        packer = Packer(window, open_windows * FAN_IN, (1 << 62) + (shift << 54) + (part << 28))
        for batch in batches:
            done: list[tuple] = []
            rows = sorted(zip(*(batch.column(k).to_pylist() for k in range(5))), key=lambda r: (-r[2], r[0], r[1]))
            for r in rows:
                for closed in packer.add(r, r[2]):
                    done += closed
            if done:
                yield _batch(done, False, _OUT)
        done = [p for w in packer.close_but(open_windows) for p in w]
        if done:
            yield _batch(done, False, _OUT)
        rest = [p for w in packer.leftovers() for p in w]
        if rest:
            yield _batch(rest, True, _OUT)

    return run


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents (doc_id, text) placed in windows of `window` ids.

    A document is its ids and then end_id; a null text is empty, so every row has at least one
    id. Returns doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset. Offsets of a sequence have no gap and start at 0. Documents
    longer than a window are cut; others are cut only to close a window that would keep
    more than SLACK ids of padding. Each partition keeps open_windows windows open; what is left in
    them when it ends is packed again, FAN_IN partitions at a time, until one group is left. Repeated
    rows are packed each; a null doc_id stays null. Other columns are ignored. Empty input: no rows.
    Whatever the input's size a task holds one batch of texts and its open windows."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = write_shared(docs.mapInArrow(_pack_texts(tokenizer_path, window, open_windows, end_id), _OUT_DDL), "pack-0")
    full = placed.where("not left_over")
    left = placed.where("left_over")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        groups = max(1, -(-parts // FAN_IN))
        # A group holds at most FAN_IN times open_windows windows of pieces.
        regrouped = left.repartition(groups, F.floor(F.col("part") / FAN_IN)).sortWithinPartitions("part", F.desc("length"), "doc_id", "start")
        again = write_shared(regrouped.mapInArrow(_merge(window, open_windows, level), _OUT_DDL), f"pack-{level}")
        full = full.unionByName(again.where("not left_over"))
        left = again.where("left_over")
        if groups == 1:
            return full.unionByName(left).select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        parts = groups
