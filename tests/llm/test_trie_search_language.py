"""Prefix trie, ranked search and language identification on awkward rows and against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from travelfields.llm import maxscore_search, ppm_language, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth long, id string, base long"


def _brute_trie(rows):
    """Nodes as the contract states them, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            named = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), role, named, text))
    seqs = {}
    for c in own:
        own[c].sort()
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        seqs[c] = tuple((r, t) for _, r, _, t in own.get(base, [])[:h]) + tuple((r, t) for _, r, _, t in turns[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    out = []
    for s, who in members.items():
        below = [x for x in members if x[: len(s)] == s]
        ends = ",".join(str(c) for c in sorted(who) if seqs[c] == s)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(who), len(s), min(members[s[:-1]]) if s else None, len(who), kids[s], sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _trie(df, **how):
    got = prefix_trie.shared_head_trie(df, **how)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("block", [65_536, 2])
def test_trie_equals_brute_force(spark, block):
    rows = [(c, t, "user" if t % 2 else None, f"turn {t} of {c % 3}" if t > 1 else "hello") for c in (100, 101, 102, 103, 150, 199, 201, 202, 250, 7, -5, -105) for t in range(c % 9 + 1)]
    rows += [(100, None, "system", "é" * 7), (100, 3, "x", None), (100, 3, "x", None), (104, 0, "only", ""), (None, 0, "lost", "lost"), (105, 0, None, None)]
    rows += [(300 + k, t, "user", f"same {t}") for k in range(40) for t in range(12)] + [(340, t, "user", f"same {t}") for t in range(11)]
    df = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], TURNS).repartition(3)
    assert _trie(df, block=block) == _brute_trie(rows)


def test_trie_of_a_long_conversation_and_of_none(spark):
    rows = [(0, t, "user", "x") for t in range(3000)] + [(c, t, "user", "x") for c in (1, 2, 3) for t in range(1500 + c)]
    got = _trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=700)
    deepest = {}
    for conv, depth, *_ in got:
        deepest[conv] = max(depth, deepest.get(conv, 0))
    assert len(got) == 3001 and max(deepest.values()) == 3000
    root = next(r for r in got if r[1] == 0)
    lengths = sorted(3000 if c == 0 else 1500 + c for c in range(4))
    assert root[3:6] == (4, 1, 1) and root[6] == sum(lengths) - 3000
    assert _trie(spark.createDataFrame([], TURNS)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=12), max_size=300, unique=True))
def test_radix_tree_holds_its_keys_in_order(keys):
    tree = prefix_trie.RadixTree()
    for k, key in enumerate(keys):
        tree.insert(key, k)
    found, paths = [], []
    for node, above, path in tree.walk():
        whole = (paths[above] if above >= 0 else b"") + path
        paths.append(whole)
        assert node.row >= 0 or above < 0 or sum(1 for _ in node.branches()) > 1
        if node.row >= 0:
            found.append((whole, node.row))
    assert found == sorted((key, k) for k, key in enumerate(keys))


def test_radix_nodes_grow_through_all_layouts():
    tree, sizes = prefix_trie.RadixTree(), []
    for b in np.random.default_rng(1).permutation(256):
        tree.insert(bytes((int(b),)), int(b))
        sizes.append(tree.root.size)
    assert sorted(set(sizes)) == [4, 16, 48, 256]
    assert [node.row for node, _, _ in tree.walk()][1:] == list(range(256))


DOCS = "doc_id long, text string, lang string, score long, rank int, item_id long"


def _brute_search(docs, items, top=50):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = [(d, cut(t)) for d, t in docs]
    lengths = [len(f) for _, f in found if f]
    n_docs, n_terms = len(lengths), sum(lengths)
    df = Counter(t for _, f in found for t in set(f))
    out = []
    for item, text in items:
        rows = []
        for d, f in found:
            count, m = Counter(f), 50 + (50 * len(f) * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * count[t]) // (1000 * count[t] + 20 * m)) for t in set(cut(text)) if count[t])
            if s > 0:
                rows.append((-s, (d is not None, d)))
        out += [(item, k + 1, d, -s) for k, (s, (_, d)) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def _texts(n, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "ÜBER", "Naïve"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    return [" ".join(rng.choice(vocabulary, rng.integers(1, 60), p=weights / weights.sum())) for _ in range(n)]


def test_search_equals_brute_force(spark):
    docs = list(enumerate(_texts(900))) + [(5, "W1 w1_w2!w3"), (5, "W1 w1_w2!w3"), (None, "w7 w8"), (2000, None), (2001, ""), (2002, "?!"), (2003, "w250 " * 4000)]
    items = [(k, t) for k, t in enumerate(_texts(20, 4))] + [(3, "w1 w1 w2"), (None, "w7"), (50, None), (51, "absent"), (52, "É über")]
    table = spark.createDataFrame([(d, t, "en", 1, 2, 3) for d, t in docs], DOCS).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = maxscore_search.search(table, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == _brute_search(docs, items)
    assert maxscore_search.search(table.limit(0), asked).count() == 0
    assert maxscore_search.search(table, asked.limit(0)).count() == 0


def test_search_prunes_and_loses_nothing(monkeypatch):
    """One segment in this process, with small blocks and windows: most blocks of common terms stay packed."""
    monkeypatch.setattr(maxscore_search, "BLOCK", 8)
    monkeypatch.setattr(maxscore_search, "WINDOW", 64)
    docs = list(enumerate(_texts(2000, 9)))
    names = sorted({t for _, x in docs for t in maxscore_search.terms(x)})
    wanted = {t: k for k, t in enumerate(names)}
    found = [Counter(maxscore_search.terms(x)) for _, x in docs]
    post = [(wanted[t], d, c) for d, f in enumerate(found) for t, c in f.items()]
    term, doc, tf = (np.array(c) for c in zip(*post))
    lengths = [sum(f.values()) for f in found]
    row = maxscore_search._segment([d for d, _ in docs], lengths, term, doc, tf)
    df = np.bincount(term, minlength=len(names))
    weights = np.array([maxscore_search.weight(len(docs), int(x)) for x in df])
    segment = maxscore_search._Segment(row, weights, len(docs), sum(lengths))
    text = "w0 w1 w2 w5 w250 w290 w299"
    scores, best = segment.search([wanted[t.encode()] for t in text.split()], 10)
    got = sorted((1, k + 1, int(d), int(s)) for k, (s, d) in enumerate(sorted(zip(scores, best), key=lambda x: (-x[0], x[1]))))
    assert sorted(got, key=str) == _brute_search(docs, [(1, text)], 10)
    blocks = sum(-(-int(df[wanted[t.encode()]]) // 8) for t in text.split())
    assert len(segment.open) < blocks * 0.6


def _brute_bits(texts, order=ppm_language.ORDER):
    """Code lengths by walking contexts with an explicit set of excluded bytes."""
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    fold = lambda t: bytes(order) + bytes(b + 32 if 65 <= b <= 90 else b for b in t)
    for t in texts:
        data = fold(t)
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[k][data[i - k : i]][data[i]] += 1

    def bits(text):
        data, total = fold(text), 0
        for i in range(order, len(data)):
            out, cost = set(), 0.0
            for k in range(order, -1, -1):
                after = {b: n for b, n in seen[k][data[i - k : i]].items() if b not in out}
                if after:
                    whole = sum(after.values()) + len(after)
                    if data[i] in after:
                        cost += math.log2(whole / after[data[i]])
                        break
                    cost += math.log2(whole / len(after))
                out |= set(after)
            else:
                cost += math.log2(256 - len(out))
            total += round(cost * 65536)
        return total

    return bits


def test_code_lengths_equal_brute_force():
    learned = {"xx": ["The cat sat on the mat", "that cat", "Übermut tut"], "yy": ["le chat est là", "la la la", ""]}
    trees = {}
    for lang, texts in learned.items():
        data = [t.encode() for t in texts]
        parts = [np.unique(g, return_counts=True) for d in data for _, g, _ in ppm_language._grams(np.frombuffer(d, np.uint8), np.array([0]), np.array([len(d)]))]
        trees[lang] = ppm_language.ContextTree(*ppm_language._merge(parts))
    model = ppm_language.LanguageModel(trees, {"xx": 3, "yy": 3})
    for text in ("the cat", "la chatte", "Ünknown ☃ bytes", "zzzz", "a"):
        data = np.frombuffer(text.encode(), np.uint8)
        (_, grams, _), = ppm_language._grams(data, np.array([0]), np.array([len(data)]))
        want = [_brute_bits([t.encode() for t in learned[x]])(text.encode()) for x in ("xx", "yy")]
        assert np.abs(model.bits(grams).astype(int).sum(0) - want).max() <= len(data)


def test_long_texts_are_cut_without_loss(monkeypatch):
    data = np.random.default_rng(2).integers(60, 100, 1000).astype(np.uint8)
    starts, ends = np.array([0, 10, 10, 700]), np.array([10, 10, 700, 1000])
    whole = {int(t): g.copy() for t, g in _by_text(data, starts, ends)}
    monkeypatch.setattr(ppm_language, "CHUNK", 64)
    cut = defaultdict(list)
    for t, g in _by_text(data, starts, ends):
        cut[int(t)].append(g)
    assert set(cut) == set(whole) == {0, 2, 3}
    assert all((np.concatenate(cut[t]) == whole[t]).all() for t in whole)


def _by_text(data, starts, ends):
    for texts, grams, offsets in ppm_language._grams(data, starts, ends):
        for t, g in zip(texts, np.split(grams, offsets[1:])):
            yield t, g


SPEECH = {
    "en": "the quick brown fox and the lazy dog went over the hill with their friends", "de": "der schnelle braune fuchs und der faule hund gingen über den hügel mit ihren freunden",
    "fr": "le renard brun rapide et le chien paresseux sont passés sur la colline avec leurs amis",
}


def _spoken(n=240):
    rng = np.random.default_rng(5)
    out = []
    for k in range(n):
        lang = ("en", "de", "fr")[k % 3]
        out.append((k, " ".join(rng.choice(SPEECH[lang].split(), 12)), lang))
    return out


def test_languages_are_told_apart_on_held_out_texts(spark):
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 + 34 !", "en"), (1003, "der hund", None), (1003, "der hund", None), (None, "le chien", "fr"), (1004, "the dog " * 20_000, "en"), (1005, "THE FRIENDS", "en")]
    table = spark.createDataFrame([(d, t, x, 9, 9, 9) for d, t, x in [*_spoken(), *odd]], DOCS).repartition(5)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    got = ppm_language.identify(table, held).collect()
    assert len(got) == 248 and all(0 <= r.score <= 1 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    truth = {d: x for d, _, x in _spoken()}
    assert all(by[d][0].lang_pred == x for d, x in truth.items() if by[d][0].held_out)
    assert sum(by[d][0].held_out for d in truth) > 40
    assert [by[d][0].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and by[1002][0].score == 0
    assert [r.lang_pred for r in by[1003]] == ["de", "de"] and by[None][0].lang_pred == "fr" and by[1004][0].lang_pred == "en" == by[1005][0].lang_pred


def test_prediction_reads_the_text_alone(spark):
    rows = _spoken(60)
    held = F.col("doc_id") >= 50
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    two = spark.createDataFrame([(d, t, x if d < 50 else "zz") for d, t, x in rows], "doc_id long, text string, lang string").repartition(7)
    a, b = (sorted(map(tuple, ppm_language.identify(x, held).collect())) for x in (one, two))
    assert a == b


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in ppm_language.identify(rows.where("doc_id = 1"), F.lit(False)).collect()} == {"und"}
    assert [r.lang_pred for r in ppm_language.identify(rows, F.lit(False)).orderBy("doc_id").collect()] == ["en", "und"]
    assert ppm_language.identify(rows.limit(0), F.lit(False)).count() == 0
