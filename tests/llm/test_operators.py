"""Each operator on awkward rows and against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from travelfields.llm import chat, embedding_dedup, fingerprints, lattice_lm, mixing, ngram_join, packing, quality, queries, sharding, suffix_dedup
from travelfields.llm.text import words

LONG = " ".join(f"word{k % 977}x{k // 7}" for k in range(6000))
BASE = [f"tok{k}" for k in range(60)]
PASSAGE = "".join(chr(97 + k * k % 23) for k in range(260))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog", "a"), (2, "The quick brown fox jumps over the lazy dog", "a"), (3, None, "a"), (4, "", "b"), (5, " \n\t", None),
    (6, LONG, "b"), (7, LONG + " tail", "b"), (8, " ".join(BASE), "c"), (9, " ".join([*BASE[:30], "new", *BASE[31:]]), None), (10, "é" + PASSAGE + "ü one", "c"), (11, "two " + PASSAGE + "ñ", "c"),
    (12, "aaaa" * 120, "c"), (13, "one two", "a"), (14, "ONE  two", "a"),
]
KIND = "doc_id long, text string, source string, lang string, n_chars long, component string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with nulls, empty and long texts, copies, and columns that operators use themselves."""
    return spark.createDataFrame([(d, t, s, "en", len(t or ""), "x", 1) for d, t, s in TEXTS], KIND).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_words_agree(spark, docs):
    from travelfields.llm.text import word_array

    odd = spark.createDataFrame([("A B\x1cC d\x0bÉ",), (None,), ("",), ("  x  ",)], "text string")
    for r in odd.select("text", word_array(F.col("text")).alias("w")).collect():
        assert r.w == words(r.text)


def test_jaccard_groups(spark, docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs).collect()}
    sets = {}
    for d, t, _ in TEXTS:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[b] = min(parent[b], parent[a])
    assert got == {d: (len(s), parent[d]) for d, s in sets.items()}
    assert ngram_join.jaccard_groups(none).count() == 0


def test_word_hashes_agree_over_long_texts():
    """Texts of several segments, words longer than a segment, and white space at the cuts."""
    text = "x" * 700_000 + " ab\tCd " + "y" * 300_000 + " q" * 400_000 + " ab É\x1cz"
    ws, hashes = words(text), ngram_join.word_hashes(text.encode()).tolist()
    of = dict(zip(ws, hashes))
    assert len(ws) == len(hashes) and [of[w] for w in ws] == hashes and len(set(of.values())) == len(of)
    assert ngram_join.word_hashes(b"CD " + b"x" * 700_000).tolist() == [of["cd"], of["x" * 700_000]]
    assert len(ngram_join.word_hashes(b" \t ")) == 0


def test_long_words_of_two_letters_are_told_apart(spark):
    """Words whose byte polynomials are equal modulo 2^64 for all values of the two bytes."""
    thue = lambda n, a, b: "".join((a, b)[bin(k).count("1") % 2] for k in range(n))
    rows = [(k, thue(n, *ends)) for k, (n, ends) in enumerate([(16, "ab"), (16, "ba"), (1024, "ab"), (1024, "ba"), (4096, "ab"), (4096, "ba"), (600_000, "ab"), (600_000, "ba")])] + [(20, "x y z")]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d for d, _ in rows}
    for n in (256, 300):
        a, b = (spark.createDataFrame([(1, thue(n, *x) * 2)], "doc_id long, text string") for x in ("ab", "ba"))
        gone = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(a.union(b.selectExpr("2L", "text"))).collect()}
        texts = {1: thue(n, *"ab").encode() * 2, 2: thue(n, *"ba").encode() * 2}
        starts = Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
        assert gone == {d: len({p for i in range(len(t) - 199) if starts[t[i : i + 200]] > 1 for p in range(i, i + 200)}) for d, t in texts.items()}


def test_signature_tree_finds_what_stars_leave_apart(spark):
    """b and c link but neither links a, the star of the shingles that all three share."""
    common = [f"s{k}" for k in range(12)]
    body = [f"b{k}" for k in range(80)]
    rows = [(1, " ".join([*common, *(f"a{k}" for k in range(60))])), (2, " ".join([*common, *body])), (3, " ".join([*common, *body[:70], *(f"c{k}" for k in range(6))]))]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2}
    s = {d: ngram_join.shingle_set(t.encode()) for d, t in rows}
    members = spark.createDataFrame([(7, d, len(s[d]), d, ngram_join._signature(s[d]).tolist()) for d in s], "key long, doc long, n long, comp long, sig array<long>")
    assert [tuple(r) for r in ngram_join.tree_candidates(members).collect()] == [(2, 3)]


def _removed(texts, length=200):
    count = Counter(b[i : i + length] for b in texts.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in texts.items():
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = True
        out[d] = (len(b), int(cover.sum()), int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~cover]))
    return out


@pytest.mark.parametrize("most", [suffix_dedup.TASK_RUNS, 1])
def test_repeats_are_removed(docs, none, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TASK_RUNS", most)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.left)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == _removed({d: (t or "").encode() for d, t, _ in TEXTS})
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_sql_of_repeats(docs):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    got = {r[0]: r[1:] for r in con.execute(queries.oracle_sql()["op4_suffix_array_dedup"]).fetchall()}
    out = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("left", 256))
    assert got == {r[0]: tuple(r[1:]) for r in out.collect()} and len(got) == len(TEXTS)


def test_columnwise_order_is_the_sorted_order():
    rng = np.random.default_rng(2)
    m = rng.integers(97, 99, (60, 24)).astype(np.uint8)
    group = np.repeat([0, 1, 2], 20)
    hit = suffix_dedup.repeated_windows(group, m, np.ones_like(m, bool), np.zeros(60, int), np.full(60, 16), 8)
    for r in range(60):
        for c in range(17):
            assert hit[r, c] == any((m[o, c : c + 8] == m[r, c : c + 8]).all() for o in range(60) if o != r and group[o] == group[r])


def test_lattice_sums_all_segmentations(spark, docs, none, tmp_path):
    import base64
    from functools import cache

    path = tmp_path / "v"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" 1" for p in (b" a", b"ab", b"b", b" ab", b"c")))
    lat = lattice_lm.Lattice(lattice_lm.read_pieces(str(path)))
    lat.logp = np.log10(np.random.default_rng(0).dirichlet(np.ones(len(lat.pieces))))
    p = dict(zip(lat.pieces, 10**lat.logp))

    @cache
    def total(b):
        return 1.0 if not b else sum(p[b[:k]] * total(b[k:]) for k in range(1, len(b) + 1) if b[:k] in p)

    for w, s in zip(ws := ["abab", "c", "abcé", "b"], lat.score(ws)):
        assert math.isclose(10**s, total(b" " + w.encode()))
    uses = lat.expected(["abab"], np.array([2.0]))
    assert math.isclose(sum(uses * [len(q) for q in lat.pieces]), 2 * 5)  # pieces cover all bytes
    got = lattice_lm.score_documents(docs, str(path), queries.held_out()).collect()
    train = Counter()
    for d, t, _ in TEXTS:
        if zlib.crc32(str(d).encode()) % 10:
            train.update([*words(t), "\n"])
    n, v = sum(train.values()), len(train)
    for r in got:
        ts = [*words(dict((d, t) for d, t, _ in TEXTS)[r.doc_id]), "\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ts), sum(train[t] > 0 for t in ts), n, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel_tol=1e-9)
        assert r.score < 0
    assert lattice_lm.score_documents(none, str(path), queries.held_out()).count() == 0


def test_mixing_meets_targets(spark, docs, none):
    rng = np.random.default_rng(5)
    rows = [(k, f"s{k % 5}" if k % 5 else None, int(v)) for k, v in enumerate(rng.integers(1, 90, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int")
    got = mixing.mix(df, F.col("n")).collect()
    again = mixing.mix(df.repartition(7), F.col("n")).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    size, weight = Counter(), dict(zip(["s1", "s2", "s3", "s4", None], (5, 2, 1, 5, 2)))
    for _, s, n in rows:
        size[s] += n
    target, open_, budget = {}, set(size), 1.5 * sum(size.values())
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            open_.discard(s)
    target |= {s: weight[s] * level for s in open_}
    taken = Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
        assert 0 <= r.copies <= 2 and r.source_size == size[r.source] and math.isclose(r.target, target[r.source])
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in size)
    out = mixing.mix(docs, queries.n_words()).collect()
    assert len(out) == len(TEXTS) and all(r.copies == 0 for r in out if not r.size)
    assert mixing.mix(none, queries.n_words()).count() == 0


def test_packing_keeps_every_id_once(spark, docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.PACK_TOKENIZER)
    tok = Tokenizer.from_file(path)
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "x\x1cy <|endoftext|> z É"), (99, "A‍B ﬁ 12 don't"), (99, "A‍B ﬁ 12 don't")], "doc_id long, text string"))
    got = packing.pack(odd, path, window=256, open_windows=4).collect()
    want = Counter()
    for r in odd.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[r.doc_id, len(ids)] += 1
        for p in (p for p in got if p.doc_id == r.doc_id):
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    seqs, docs_len = {}, Counter()
    for p in got:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs_len[p.doc_id, p.doc_tokens] += p.length
    assert docs_len == Counter({k: n * k[1] for k, n in want.items()})
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(none, path).count() == 0


def test_long_words_are_summed_in_chunks(monkeypatch):
    lat = lattice_lm.Lattice([b"a", b"ab", b"abc", b"bca", b" ab", b"cab", b"aaaaaaa"])
    rng = np.random.default_rng(3)
    lat.logp = np.log10(rng.dirichlet(np.ones(len(lat.keys))))
    ws = ["".join(rng.choice(list("abc"), n)) for n in (1, 2, 6, 15, 16, 17, 40, 200)] + ["aaaaaaaaaaaaaaaaaaaa", "é" * 30]
    weight = rng.random(len(ws)) + 0.5
    score, uses = lat.score(ws), lat.expected(ws, weight)
    for chunk in (1, 3, 16, 1000):
        monkeypatch.setattr(lattice_lm, "CELLS", 0)
        monkeypatch.setattr(lattice_lm, "CHUNK", chunk)
        assert np.allclose(lat.score(ws), score, rtol=1e-12) and np.allclose(lat.expected(ws, weight), uses, rtol=1e-9)


def test_chat_rotation(spark):
    rows = [(1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 0, "system", "be kind"), (1, 2, "bob", None), (1, None, "ann", "lost"), (2, 0, None, ""), (None, 0, "cy", "x"), (3, 0, "system", "alone"), (1, 200, "cy", "late")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, block int")
    got = {(r.conv_id, r.perspective, r.block): r for r in chat.rotate_perspectives(df).collect()}
    r = got[1, "bob", 0]
    assert r.rendered == "<|user name=ann|>\nlost<|end|>\n<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi<|end|>\n<|assistant|>\n<|end|>\n<|user name=cy|>\nlate<|end|>\n"
    assert (r.mask, r.n_messages, r.first_message) == ("00010", 5, 0) and [r.rendered[s.start : s.end] for s in r.train_spans] == ["<|end|>\n"]
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "cy", 0), (2, "unknown", 0), (None, "cy", 0)}
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_long_dialogues_are_whole_or_cut_by_place(spark):
    df = spark.createDataFrame([(1, 10 * t, "ab"[t % 2], f"m{t}") for t in range(100)], "conv_id long, turn long, role string, text string")
    whole = {r.perspective: r for r in chat.rotate_perspectives(df).collect()}
    assert set(whole) == {"a", "b"} and all(r.n_messages == 100 for r in whole.values())
    cut = sorted(chat.rotate_perspectives(df, 64).collect(), key=lambda r: (r.perspective, r.block))
    assert [(r.perspective, r.block, r.first_message, r.n_messages) for r in cut] == [(p, b, 64 * b, n) for p in "ab" for b, n in ((0, 64), (1, 36))]
    assert all("".join(r.rendered for r in cut if r.perspective == p) == whole[p].rendered for p in "ab")


def test_sharding(spark, docs):
    table = sharding.slot_table([f"s{k}" for k in range(7)], 1009)
    share = Counter(table)
    assert len(table) == 1009 and max(share.values()) - min(share.values()) <= 1
    less = sharding.slot_table([f"s{k}" for k in range(6)], 1009)
    moved = sum(a != b for a, b in zip(table, less) if a != 6)
    assert moved < 0.25 * 1009
    rows = docs.select("doc_id", F.lit(3).alias("shard")).union(spark.createDataFrame([(None, 1), (1, 2)], "doc_id long, shard int"))
    got = sharding.place(rows, F.col("doc_id"), queries.SHARDS).collect()
    table = sharding.slot_table(queries.SHARDS)
    for r in got:
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r.shard_slot, r.shard) == (slot, table[slot])
    assert len(got) == len(TEXTS) + 2
    with pytest.raises(ValueError):
        sharding.slot_table(["a"], 1000)


def test_fingerprints(spark, docs, none):
    same = spark.createDataFrame([(1, "Straße  É\n"), (2, " STRASSE é"), (3, "ﬁn"), (4, "fin"), (5, None), (6, " "), (7, "fim"), (None, "fin")], "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(same).collect()}
    assert f[1] == f[2] and f[3] == f[4] == f[None] and f[5] == f[6] and len({f[1], f[3], f[5], f[7]}) == 4
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_edits(docs).collect()}
    order = sorted(TEXTS, reverse=True)
    for k, (d, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0 and got[3].near_next == 0.0 and got[4].near_next == 1.0
    assert fingerprints.fingerprint_with_edits(none).count() == 0


def test_colliding_buckets_are_told_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda c: F.struct((F.length(c) % 2).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")))
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert got[1] == got[2] and got[3] == got[4] == got[5] and got[13] == got[14]
    assert len(set(got.values())) == 10


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [(k, (base[k // 5] + rng.normal(size=16) * 0.18 * (k % 5)).tolist(), k // 20) for k in range(160)]
    rows += [(200, rows[0][1], 0), (201, [2 * v for v in rows[0][1]], 0), (202, rows[0][1], None), (203, [0.0] * 16, 0), (204, None, 0), (205, [math.nan] * 16, 0), (206, [None, *([1.0] * 15)], 0), (207, [1.0, 2.0], 0), (208, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, rows[5]]], "vec_id long, embedding array<float>, label int, component string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    ok = {k: (np.float32(v).astype(float), lab) for k, v, lab in rows if k < 202}
    links = {k: {o for o in ok if o != k and ok[o][1] == ok[k][1] and ok[o][0] @ ok[k][0] / math.sqrt((ok[o][0] @ ok[o][0]) * (ok[k][0] @ ok[k][0])) >= 0.93} for k in ok}
    comp = {k: k for k in ok}
    for _ in ok:
        comp = {k: min([comp[k], *(comp[o] for o in links[k])]) for k in ok}
    assert {k: got[k] for k in ok} == {k: (len(links[k]), comp[k], comp[k] == k) for k in ok}
    assert all(got[k] == (0, k, True) for k in range(202, 209)) and len(got) == len(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_forest_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x[3000:] = x[:3000] + rng.normal(size=(3000, 32)).astype(np.float32) * 0.3
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    true = (u @ u.T >= 0.93).sum(1) - 1
    assert true.sum() > 1000 and sum(got.values()) >= 0.9 * true.sum() and all(got[k] <= true[k] for k in got)


def test_forest_keeps_dense_groups_whole():
    """Thousands of non-identical near copies in one label: no link may be lost by splits."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 64))
    x[:3000] = x[0] + rng.normal(size=(3000, 64)) * 0.26
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    label = np.zeros(9000, np.int32)
    x, label = np.concatenate([x, x[::-1]]), np.concatenate([label, label + 7])
    f = embedding_dedup.Forest(x, label, 1.0, 6)
    for single in (False, True):  # by the trees themselves, and by the short way of one leaf
        f.single[:] = single
        row, leaf = f.leaves(x[:9000], label[:9000])
        found = np.zeros((9000, 9000), bool)
        for g in np.split(row[np.argsort(leaf, kind="stable")], np.flatnonzero(np.diff(np.sort(leaf))) + 1):
            found[np.ix_(g, g)] |= True
        true = x[:9000] @ x[:9000].T >= 0.93
        assert true.sum() > 4_000_000 and (found & true).sum() >= 0.99 * true.sum()


def test_dense_group_links(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x[::3] = x[0] + rng.normal(size=(2000, 64)) * 0.26
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    true = (u @ u.T >= 0.93).sum(1) - 1
    assert true.sum() > 1_000_000 and sum(got.values()) >= 0.99 * true.sum() and all(got[k] <= true[k] for k in got)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(d, d != 12) for d, _, _ in TEXTS] + [(None, True), (1, None)], "doc_id long, good boolean")
    run = lambda d, lab: quality.classify(d, lab, F.col("source"), F.col("lang"), F.col("doc_id"), F.col("component")).collect()
    got = run(docs, labels)
    assert len(got) == len(TEXTS) and all(0 < r.quality < 1 and r.component == "x" for r in got)
    assert all(r.keep for r in run(docs, labels.where("good"))) and run(none, labels) == []
    assert len({round(r.doc_score, 9) for r in run(docs, labels.limit(0))}) == 1


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), queries.good_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    train = F.xxhash64("doc_id") % 2 == 0
    got = quality.classify(d, lab.where(train), F.col("source"), F.col("lang"), F.col("doc_id")).join(lab.where(~train), "doc_id").collect()
    clean = [r.keep for r in got if r.good]
    assert sum(clean) >= 0.95 * len(clean) and sum(r.keep == r.good for r in got) >= 0.85 * len(got)


def test_repeated_vectors_and_null_ids(spark):
    v, w = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    rows = [(1, v, 0), (1, v, None), (1, None, 0), (2, w, 0), (2, w, 0), (None, v, 0), (None, v, 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert [tuple(r) for r in got if r.vec_id is None] == [(None, 0, None, True)] * 2


def test_jaccard_rows_of_repeated_ids(spark):
    """Rows, not ids, are documents: repeats, null ids, and one id for two texts."""
    a, b = " ".join(BASE), " ".join(f"other{k}" for k in range(50))
    rows = [(5, a, 1), (5, a, 1), (7, a + " x", 2), (3, b, 3), (7, b, 4), (None, a, 5), (None, None, 6), (None, None, 6), (9, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(df).collect())
    assert got == Counter([(5, 56, 5), (5, 56, 5), (7, 57, 5), (3, 46, 3), (7, 46, 3), (None, 56, 5), (None, 0, None), (None, 0, None), (9, 0, 9)])
    first = [r for r in ngram_join.jaccard_rows(df).collect() if r.is_first]
    assert sorted((r.component_id or 0, r.doc_id or 0) for r in first) == [(0, 0), (0, 0), (3, 3), (5, 5), (9, 9)]


def test_traversal_finds_all_pairs_of_a_large_root(spark, monkeypatch):
    """A root of several nodes, sizes and widths of bitmaps: all linked pairs of different components are proposed."""
    monkeypatch.setattr(ngram_join, "NODE_ROWS", 32)
    rng = np.random.default_rng(1)
    sets = []
    for k in range(120):
        body = rng.integers(0, 1 << 40, int(rng.integers(5, 400)))
        sets += [np.unique(np.concatenate(([7], body))), np.unique(np.concatenate(([7], body[: max(1, int(len(body) * rng.uniform(0.6, 1)))])))]
    rows = [(7, k, len(s), k, ngram_join._signature(s.astype(np.int64)).tolist()) for k, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "key long, doc long, n long, comp long, sig array<long>")
    got = {tuple(r) for r in ngram_join.tree_candidates(members).collect()}
    links = {(a, b) for a in range(240) for b in range(a + 1, 240) if 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - k)}
    assert links and links <= got and len(got) < 2000
    forest = {tuple(r) for r in ngram_join.tree_candidates(members, forest=True).collect()}
    assert forest <= got


def test_fingerprints_of_repeated_rows(spark):
    rows = [(1, "ab"), (1, "ab"), (1, "cd"), (2, "xyz"), (None, "q"), (None, None), (2, "xyz")]
    got = fingerprints.fingerprint_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((d, len(t or "")) for d, t in rows)
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 2 and len({r.fingerprint for r in got if r.doc_id == 2}) == 1


def _tilt(sizes, target, cap=2.0):
    """The rates nearest an equal start that meet a target, by bisection on the tilt."""
    mean, lo, hi = sum(sizes) / len(sizes), -60.0, 60.0
    for _ in range(200):
        lam = (lo + hi) / 2
        lo, hi = (lam, hi) if sum(x * cap / (1 + math.exp(-lam * x / mean)) for x in sizes) < target else (lo, lam)
    return lam


def test_balance_solves_the_dual(spark):
    rng = np.random.default_rng(8)
    sizes = {k: rng.integers(1, 300, 200).tolist() for k in (1, 2, 3)}
    share = {1: 0.2, 2: 1.0, 3: 1.7}
    cells = mixing.write_shared(spark.createDataFrame([(k, x, n) for k, v in sizes.items() for x, n in Counter(v).items()], "source_key long, size long, n long"), "test-cells")
    targets = spark.createDataFrame([(k, sum(v), share[k] * sum(v)) for k, v in sizes.items()], "source_key long, source_size long, target double")
    for r in mixing.balance(cells, targets).collect():
        assert math.isclose(r.lam, _tilt(sizes[r.source_key], share[r.source_key] * sum(sizes[r.source_key])), abs_tol=1e-4)


def test_site_posteriors_shrink_sparse_sites(spark):
    """Against the same formulas in plain Python: one-row, null and large sites."""
    rng = np.random.default_rng(9)
    sites = [("big", "a", 60, 0.8), ("big", "b", 40, 0.6), ("one", "a", 1, 0.1), (None, "a", 5, 0.3), (None, None, 1, 0.9), ("mid", None, 12, 0.2)]
    rows = [(h, p, float(np.clip(m + rng.normal() * 0.1, 0.01, 0.99))) for h, p, n, m in sites for _ in range(n)]
    got, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, doc_score double"))
    by = {}
    for h, p, x in rows:
        by.setdefault(h, {}).setdefault(p, []).append(x)
    glob = (sum(x for _, _, x in rows) + 0.5) / (len(rows) + 1)

    def strength(groups):  # (values, center)
        own = [(np.mean(v), np.var(v), len(v), c) for v, c in groups if len(v) > 1]
        extra = np.mean([(m - c) ** 2 for m, _, _, c in own]) - np.mean([v / n for _, v, n, _ in own])
        return min(1e6, max(2.0, np.mean([c * (1 - c) for *_, c in own]) / extra - 1)) if extra > 0 else 1e6

    k = strength([(sum(ps.values(), []), glob) for ps in by.values()])
    host = {h: (k * glob + sum(sum(ps.values(), []))) / (k + len(sum(ps.values(), []))) for h, ps in by.items()}
    kp = strength([(v, host[h]) for h, ps in by.items() for v in ps.values()])
    assert math.isclose(mean, glob)
    out = {(r.host, r.path): r for r in got.collect()}
    assert set(out) == {(h, p) for h, ps in by.items() for p in ps}
    for (h, p), r in out.items():
        assert math.isclose(r.host_posterior, host[h], rel_tol=1e-9) and math.isclose(r.path_strength, kp, rel_tol=1e-6)
        assert r.n == len(by[h][p]) and math.isclose(r.total, sum(by[h][p]))
    assert abs(host["one"] - glob) < abs(0.1 - glob) / 2
