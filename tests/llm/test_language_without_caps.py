"""Languages are told by all counts and all languages, however few grams go to the tasks."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from travelfields.llm import ppm_language as P


def _texts():
    rng = np.random.default_rng(11)
    out = []
    for k in range(60):
        letters = "abcdefgh" if k % 3 == 0 else "efghijkl" if k % 3 == 1 else "aeixyzüñ"
        out.append((k, " ".join("".join(rng.choice(list(letters), 4)) for _ in range(15)) if k % 13 else "", f"l{k % 3}"))
    return [*out, (100, "ABCD efgh 12", None), (100, "ABCD efgh 12", None), (101, None, "l1"), (102, "zzzz" * 50, "l2"), (103, "12", "l0")]


def _brute(rows, held):
    """Bits of the best language of each text and its share, from whole trees."""
    grams, texts = defaultdict(list), defaultdict(int)
    of = lambda t: next((g for _, g, _ in P._grams(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t.encode())]))), np.zeros(0, np.int64))
    for d, t, x in rows:
        if x is not None and not held(d):
            grams[x].append(np.unique(of(t or ""), return_counts=True))
            texts[x] += 1
    model = P.LanguageModel({x: P.ContextTree(*P._merge(g)) for x, g in grams.items()}, dict(texts))
    out = {}
    for d, t, _ in rows:
        total = model.prior + (model.bits(of(t)).astype(np.int64).sum(0) if t else 0)
        best = int(total.argmin())
        letter = any(c.isalpha() for c in t or "")
        out[d] = (model.langs[best], total[best] / 65536, 1 / sum(math.exp2(-min((x - total[best]) / 65536, 1000)) for x in total)) if letter else ("und", 0, 0)
    return out


@pytest.mark.parametrize("nodes, languages, bucket", [(1 << 18, 64, 200_000), (8, 64, 50), (0, 64, 50), (8, 2, 50), (1 << 18, 1, 50)])
def test_no_count_and_no_language_is_left_out(spark, monkeypatch, nodes, languages, bucket):
    monkeypatch.setattr(P, "NODES", nodes)
    monkeypatch.setattr(P, "LANGUAGES", languages)
    monkeypatch.setattr(P, "BUCKET", bucket)
    rows = _texts()
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = P.identify(table, F.col("doc_id") % 4 == 1).collect()
    want = _brute(rows, lambda d: d % 4 == 1)
    assert sorted(r.doc_id for r in got) == sorted(d for d, _, _ in rows)
    for r in got:
        lang, bits, share = want[r.doc_id]
        assert (r.lang_pred, r.bits) == (lang, bits) and r.score == pytest.approx(share, abs=1e-9)
