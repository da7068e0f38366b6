"""Prefix tries of conversations in adaptive radix trees.

A turn is named by a number of fixed width (ID bytes, big-endian: the first 128 bits of SHA-256 over its role and text), a conversation by the numbers of its turns one behind
the other. Distinct conversations are sorted and dealt by ranges of that key; a task puts its keys into an adaptive radix tree, whose inner nodes hold up
to 4, 16, 48 or 256 branches and grow as needed, and whose unary paths are compressed. Only byte depths at a turn's end are nodes of the trie; each task
hands out its share of each, and shares of a node that several tasks met are added up.

Sorted keys are the trie in preorder, so a subtree is an interval of keys: what it holds is the difference of two running sums plus the rest of the
path on which its top was first met. No level is walked after another, whatever the depth, but for conversations of more than `block` turns: these are cut
into keys of that many turns, each below the node at which the one before it ends."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from travelfields.operators.indexing import dense_index
from travelfields.shared import scratch, write_shared

#: Bytes of a turn's number.
ID = 16
#: Turns of a key at most, 1 MB of numbers.
BLOCK_TURNS = 65_536
#: Keys and bytes of keys in a tree at most; a task that holds more builds several.
TREE_KEYS, TREE_BYTES = 20_000, 1 << 25
#: Turns that a conversation takes over from the first of its hundred, at most.
MOST_SHARED = 5


class Node:
    """An inner node or leaf: the bytes that lead to it from its branch, what ends here (a row number, or none) and its branches. Up to 16 branches are
    searched in sorted bytes, up to 48 through an index of 256 places, more are addressed."""

    __slots__ = ("path", "row", "size", "labels", "kids")

    def __init__(self, path: bytes, row: int = -1):
        self.path, self.row, self.size, self.labels, self.kids = path, row, 4, bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.size <= 16:
            k = self.labels.find(byte)
            return self.kids[k] if k >= 0 else None
        if self.size == 48:
            k = self.labels[byte]
            return self.kids[k - 1] if k else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Set the branch of a byte, in a larger layout if this one is full."""
        if self.size <= 16:
            k = self.labels.find(byte)
            if k >= 0:
                self.kids[k] = kid
                return
            if len(self.kids) < self.size or self.size == 4:
                self.size = 16 if len(self.kids) == 4 else self.size
                k = sum(x < byte for x in self.labels)
                self.labels.insert(k, byte)
                self.kids.insert(k, kid)
                return
            index = bytearray(256)
            for k, x in enumerate(self.labels):
                index[x] = k + 1
            self.size, self.labels = 48, index
        if self.size == 48:
            if self.labels[byte]:
                self.kids[self.labels[byte] - 1] = kid
                return
            if len(self.kids) < 48:
                self.kids.append(kid)
                self.labels[byte] = len(self.kids)
                return
            self.size, self.kids, self.labels = 256, [self.kids[x - 1] if x else None for x in self.labels], bytearray()
        self.kids[byte] = kid

    def branches(self):
        """(byte, node) by ascending byte."""
        if self.size <= 16:
            return zip(self.labels, self.kids)
        if self.size == 48:
            return ((b, self.kids[k - 1]) for b, k in enumerate(self.labels) if k)
        return ((b, kid) for b, kid in enumerate(self.kids) if kid is not None)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, row: int) -> None:
        node, above, label, at = self.root, None, 0, 0
        while True:
            same = _common(node.path, key[at : at + len(node.path)])
            if same < len(node.path):
                split = Node(node.path[:same])
                split.put(node.path[same], node)
                node.path = node.path[same + 1 :]
                if above is None:
                    self.root = split
                else:
                    above.put(label, split)
                node = split
            at += same
            if at == len(key):
                node.row = row
                return
            nxt = node.find(key[at])
            if nxt is None:
                node.put(key[at], Node(key[at + 1 :], row))
                return
            above, label, node, at = node, key[at], nxt, at + 1

    def walk(self):
        """(node, number of the node above or -1, bytes that lead to it) in preorder."""
        stack = [(self.root, -1, self.root.path)]
        seen = 0
        while stack:
            node, above, path = stack.pop()
            yield node, above, path
            mine, seen = seen, seen + 1
            stack.extend(reversed([(kid, mine, bytes((b,)) + kid.path) for b, kid in node.branches()]))


def _name(prefix: bytes, key: bytes, full: bool) -> bytes:
    """The number of the node at key below prefix. A full block goes in by its digest, so that chains of blocks can be named from digests."""
    return hashlib.sha256(prefix + (hashlib.sha256(key).digest() if full else key)).digest()[:ID]


def _shares(prefix: bytes, level: int, rows: list[tuple], block: int):
    """Shares of trie nodes below prefix. rows: (key, members, lowest conv_id, place in the order, code points by turn)."""
    tree = RadixTree()
    for k, r in enumerate(rows):
        tree.insert(r[0], k)
    seen = list(tree.walk())
    size, low, first, last, some = ([0] * len(seen) for _ in range(5))
    for k in range(len(seen) - 1, -1, -1):
        node, above, _ = seen[k]
        if node.row >= 0:
            _, n, least, place, _ = rows[node.row]
            kids = size[k] > 0
            size[k], low[k] = size[k] + n, min(low[k], least) if kids else least
            first[k], last[k] = min(first[k], place) if kids else place, max(last[k], place) if kids else place
            some[k] = node.row
        if above >= 0:
            kids = size[above] > 0
            size[above] += size[k]
            low[above] = min(low[above], low[k]) if kids else low[k]
            first[above], last[above] = (min(first[above], first[k]), max(last[above], last[k])) if kids else (first[k], last[k])
            some[above] = some[k]
    if level == 0:
        yield _name(b"", b"", False), b"", 0, size[0], low[0], first[0], last[0], 0
    # Of each tree node: the hash and name at the last turn's end on its path, how many turns that is, and bytes since.
    reached: list[tuple] = []
    for k, (_, above, path) in enumerate(seen):
        hashed, name, turns, rest = reached[above] if above >= 0 else (hashlib.sha256(prefix), prefix if level else _name(b"", b"", False), 0, b"")
        rest += path
        for at in range(0, len(rest) - ID + 1, ID):
            hashed = hashed.copy()
            hashed.update(rest[at : at + ID])
            turns += 1
            key, _, _, _, chars = rows[some[k]]
            up, name = name, _name(prefix, key[: turns * ID], True) if turns == block else hashed.digest()[:ID]
            yield name, up, level * block + turns, size[k], low[k], first[k], last[k], chars[turns - 1]
        reached.append((hashed, name, turns, rest[len(rest) - len(rest) % ID :]))


_SHARE = "node_id binary, parent_id binary, depth long, n_convs long, low long, first long, last long, chars long"
_ARROW = pa.schema([("node_id", pa.binary()), ("parent_id", pa.binary()), *((c, pa.int64()) for c in ("depth", "n_convs", "low", "first", "last", "chars"))])


def _grow(batches, level: int, block: int):
    held: dict[bytes, list] = {}
    keys = size = 0

    def emit():
        out: list[tuple] = []
        for prefix, rows in held.items():
            for share in _shares(prefix, level, rows, block):
                out.append(share)
                if len(out) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)
        held.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("prefix", "key", "n", "low", "place", "chars")]
        for prefix, *row in zip(*columns):
            held.setdefault(prefix, []).append(tuple(row))
            keys, size = keys + 1, size + len(row[0])
            if keys == TREE_KEYS or size > TREE_BYTES:
                yield from emit()
                keys = size = 0
    yield from emit()


def turn_id(role: Column, text: Column) -> Column:
    """The turn's number as hexadecimal digits."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * ID)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, chars): turns in order from 0. Equal turns of one conversation go by role and then by their number; rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), turn_id(role, text).alias("id"), F.length(text).cast("long").alias("chars"))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "id")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "id", "chars")


def rebuild_with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations, all conversations). Conversation c begins with the first crc32(c) % 6 turns of c - c % 100 and goes on
    with its own behind as many."""
    c = F.col("conv_id")
    convs = turns.where("pos = 0").select("conv_id", (F.crc32(c.cast("string").cast("binary")) % (MOST_SHARED + 1)).alias("h"), (c - c % 100).alias("base"))
    heads = turns.where((F.col("pos") < MOST_SHARED) & (c % 100 == 0)).withColumnRenamed("conv_id", "base")
    there = heads.groupBy("base").agg(F.count("*").alias("there"))
    convs = write_shared(convs.join(there, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))), "trie-convs")
    shared = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "id", "chars")
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "id", "chars")
    return shared.unionByName(own), convs.select("conv_id")


def _keys(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """(conv_id, level, prefix, key, chars, at_end): each conversation's turns in blocks, the prefix naming what stands before a block."""
    cut = turns.withColumn("level", F.floor(F.col("pos") / block).cast("int")).groupBy("conv_id", "level").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "chars"))).alias("t"))
    some = cut.select("conv_id", "level", F.unhex(F.array_join("t.id", "")).alias("key"), F.col("t.chars").alias("chars"))
    none = convs.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(0).alias("level"), F.lit(b"").alias("key"), F.array().cast("array<long>").alias("chars"))
    both = write_shared(some.unionByName(none), "trie-blocks")
    if both.where("level > 0").isEmpty():
        return both.withColumn("prefix", F.lit(b"")).withColumn("at_end", F.lit(True))
    digest = F.sha2("key", 256)
    line = both.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", digest.alias("d")))), lambda x: x["d"]).alias("digests"))
    name = lambda p, d: F.unhex(F.substring(F.sha2(F.concat(p, F.unhex(d)), 256), 1, 2 * ID))
    prefix = F.aggregate(F.slice("digests", F.lit(1), F.col("level")), F.lit(b""), name)
    return both.join(line, "conv_id").select("conv_id", "level", "key", "chars", prefix.alias("prefix"), (F.col("level") + 1 == F.size("digests")).alias("at_end"))


def _end_digests(keys: DataFrame, block: int) -> DataFrame:
    """(node_id, ends_sha256): ids of the conversations that end at a node, ascending, joined by commas. Ids go on in runs of at most 4,096,
    and a node's runs are hashed one after the other as they come, sorted."""
    body = F.when(F.octet_length("key") == block * ID, F.unhex(F.sha2("key", 256))).otherwise(F.col("key"))
    ends = keys.where("at_end").select(F.unhex(F.substring(F.sha2(F.concat("prefix", body), 256), 1, 2 * ID)).alias("node_id"), "conv_id")
    run = ends.groupBy("node_id", F.shiftright("conv_id", 12).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches):
        current, hashed, out = None, None, []
        for batch in batches:
            for node, ids in zip(batch.column("node_id").to_pylist(), batch.column("ids").to_pylist()):
                if node != current:
                    if current is not None:
                        out.append((current, hashed.hexdigest()))
                    current, hashed = node, hashlib.sha256(ids.encode())
                else:
                    hashed.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["node_id", "ends_sha256"])
                out = []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([hashed.hexdigest()])], ["node_id", "ends_sha256"])

    return run.repartition("node_id").sortWithinPartitions("node_id", "run").select("node_id", "ids").mapInArrow(digest, "node_id binary, ends_sha256 string")


def _running(values: DataFrame, by: str, span: int = 65_536) -> DataFrame:
    """values (by: 0 to N-1 without gaps, saved, leaves) with sums up to and with each row; only a sum for each `span` rows is added up in one place."""
    part = values.withColumn("span", F.floor(F.col(by) / span).cast("long"))
    inside = W.partitionBy("span").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(F.lit(0)).orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    sums = part.groupBy("span").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    offsets = sums.select("span", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "sl"))
    return part.select(by, "span", F.sum("saved").over(inside).alias("a"), F.sum("leaves").over(inside).alias("b")).join(offsets, "span").select(by, (F.col("a") + F.col("s0")).alias("run_saved"), (F.col("b") + F.col("l0")).alias("run_leaves"))


def _level(keys: DataFrame, level: int, below: DataFrame | None, block: int) -> DataFrame:
    """Nodes of one level with the sums of their subtrees. below: (node_id, children, leaves, saved) of what hangs under ends of full blocks."""
    distinct = keys.where(F.col("level") == level).groupBy("prefix", "key").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("chars").alias("chars"))
    placed = dense_index(distinct.withColumn("line", F.concat("prefix", "key")), "line", "place").select("prefix", "key", "n", "low", "place", "chars")
    shares = placed.mapInArrow(lambda b: _grow(b, level, block), _SHARE)
    sums = (F.sum("n_convs").alias("n_convs"), F.min("low").alias("low"), F.min("first").alias("first"), F.max("last").alias("last"))
    nodes = write_shared(shares.groupBy("node_id", "parent_id", "depth", "chars").agg(*sums), "trie-nodes")
    kids = nodes.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    known = nodes.join(kids, "node_id", "left")
    if below is not None:
        known = known.join(below.toDF("node_id", "more", "more_leaves", "more_saved"), "node_id", "left")
    else:
        known = known.select("*", *(F.lit(None).cast("long").alias(c) for c in ("more", "more_leaves", "more_saved")))
    known = known.withColumn("n_children", F.coalesce("children", F.lit(0)) + F.coalesce("more", F.lit(0)))
    known = known.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("more_leaves", F.lit(0))).cast("long"))
    known = known.withColumn("gain", (F.col("n_convs") - 1) * F.col("chars") + F.coalesce("more_saved", F.lit(0)))
    path = W.partitionBy("first").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    known = known.select("node_id", "parent_id", "depth", "n_convs", "low", "first", "last", "n_children", F.sum("gain").over(path).alias("saved"), F.sum("leaf").over(path).alias("leaves"))
    known = write_shared(known, "trie-paths")
    # The uppermost node of a path has its sums.
    whole = known.groupBy("first").agg(F.max(F.struct(-F.col("depth"), "saved", "leaves")).alias("m")).select("first", "m.saved", "m.leaves")
    run = write_shared(_running(whole, "first"), "trie-sums")
    wide = known.where("last > first").join(run.toDF("last", "saved_last", "leaves_last"), "last").join(run.toDF("first", "saved_first", "leaves_first"), "first")
    columns = ["node_id", "parent_id", "depth", "n_convs", "low", "n_children"]
    wide = wide.select(*columns, (F.col("saved") + F.col("saved_last") - F.col("saved_first")).alias("saved"), (F.col("leaves") + F.col("leaves_last") - F.col("leaves_first")).alias("leaves"))
    return write_shared(known.where("last = first").select(*columns, "saved", "leaves").unionByName(wide), "trie-level")


def trie_nodes(turns: DataFrame, convs: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """The trie of conversations. turns: (conv_id, pos, id, chars), pos from 0 without gaps, id as by turn_id. convs: (conv_id), those without turns too.

    One row for each distinct sequence of first turns, the empty one included: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (over the subtree: members but one times code points of the last turn), ends_sha256 (of the comma-joined ids of members with no further turn).
    Equal conversations are counted before they are sorted. Without conversations there is no node. A written table."""
    with scratch():
        keys = write_shared(_keys(turns, convs, block), "trie-keys")
        top = keys.agg(F.max("level")).first()[0]
        below, levels = None, []
        for level in range(top if top is not None else -1, -1, -1):
            nodes = _level(keys, level, below, block)
            below = nodes.where(F.col("depth") == level * block + 1).groupBy("parent_id").agg(F.count("*"), F.sum("leaves"), F.sum("saved")) if level else None
            levels.append(nodes)
        if not levels:
            nodes = keys.select(F.lit(b"").alias("node_id"), F.lit(b"").alias("parent_id"), *(F.lit(0).cast("long").alias(c) for c in ("depth", "n_convs", "low", "n_children", "saved", "leaves")))
        else:
            nodes = levels[0]
            for more in levels[1:]:
                nodes = nodes.unionByName(more)
        names = nodes.select(F.col("node_id").alias("parent_id"), F.col("low").alias("parent_conv_id"))
        out = nodes.join(names, "parent_id", "left").join(_end_digests(keys, block), "node_id", "left").select(
            F.col("low").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
        return write_shared(out, "trie", keep=True)


def shared_head_trie(conversations: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """trie_nodes of conversations (conv_id, turn, role, text) rebuilt with shared heads. Turns go by `turn`, null first; a null role or text is empty; further
    columns aren't read; equal rows are turns each."""
    with scratch():
        turns = write_shared(numbered_turns(conversations), "trie-turns")
        rebuilt, convs = rebuild_with_shared_heads(turns)
        return write_shared(trie_nodes(rebuilt, convs, block), "trie-out", keep=True)
