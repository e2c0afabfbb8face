"""Scores against a dictionary model, dealt contexts, tries, odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import odd_docs, plain_docs
from pyspark.sql import functions as F

from clickloom.llm import ngram_lm
from clickloom.llm.elias_fano import EliasFano, NgramTrie, quantised, restored


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows, held):
    train = [tokens(t) for i, t in rows if not held(i)]
    one = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([0, *t], t, strict=False))
    context, kinds = Counter(), Counter()
    for (u, _), n in pairs.items():
        context[u] += n
        kinds[u] += 1
    n, v = sum(one.values()), len(one)
    out = defaultdict(list)
    for i, text in rows:
        t = tokens(text)
        base = [(one[w] + 1) / (n + v + 1) for w in t]
        score = 0.0
        for u, w, p in zip([0, *t], t, base, strict=False):
            whole = context[u] + kinds[u]
            score += math.log10(pairs[u, w] / whole + kinds[u] / whole * p if whole else p)
        out[i].append((len(t), sum(one[w] > 0 for w in t), n, sum(map(math.log10, base)), score))
    return out


def check(spark, docs, rows, held, **sizes):
    got = ngram_lm.score_texts(docs, F.col("doc_id") % 5 == 2, **sizes).collect()
    want = brute(rows, held)
    assert len(got) == len(rows)
    for r in got:
        close = [w for w in want[r["doc_id"]] if (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and math.isclose(r["base_score"], w[3], rel_tol=1e-9, abs_tol=1e-9)]
        assert close, r
        # A quantised probability is off by half a step at most.
        assert any(abs(r["score"] - w[4]) <= r["n_tokens"] * 0.51 / 28 for w in close), (r, close)
        assert r["held_out"] == held(r["doc_id"])


def held(i):
    return i is not None and i % 5 == 2


@pytest.mark.parametrize("block,shard", [(1 << 20, 1 << 20), (2_000, 600)])
def test_scores_equal_a_dictionary_model(spark, block, shard):
    rng = random.Random(6)
    words = ["the"] * 30 + ["Of"] * 5 + [f"w{i}" for i in range(60)] + ["é", "\u2003x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 40, 80])))) for i in range(120)]
    docs = plain_docs(spark, [(i, t, None, None) for i, t in rows]).repartition(3)
    if shard < 1_000:  # so that frequent contexts are dealt over several shards
        assert len(ngram_lm.Frequent(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)).of(np.zeros(3, np.uint64))) == 3
    check(spark, docs, rows, held, block_bytes=block, shard_bytes=shard)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(spark, docs, rows, held)
    assert ngram_lm.score_texts(plain_docs(spark, []), F.lit(False)).count() == 0
    untaught = ngram_lm.score_texts(docs, F.lit(True)).collect()
    assert {(r["base_score"], r["score"], r["n_known"], r["train_tokens"]) for r in untaught} == {(0.0, 0.0, 0, 0)}


def test_real_texts_beat_the_base_when_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ngram_lm.score_texts(docs, F.col("doc_id") % 5 == 2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_elias_fano_sequences():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, top = int(rng.integers(0, 200)), int(rng.choice(np.array([0, 1, 5, 1000, 1 << 40, (1 << 64) - 1], dtype=np.uint64)))
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        sequence = EliasFano(values, top)
        asked = np.concatenate((values, rng.integers(0, top, 50, dtype=np.uint64, endpoint=True)))
        found = sequence.find(asked)
        assert np.array_equal(found >= 0, np.isin(asked, values))
        assert np.array_equal(values[found[found >= 0]], asked[found >= 0])
        assert not n or np.array_equal(sequence.access(np.arange(n)), values)


def test_trie_answers_within_the_context():
    contexts = np.array([5, 9, 1 << 60], dtype=np.uint64)
    successors = np.array([1, 7, 7, 2, 3], dtype=np.uint64)
    chance = np.array([0.5, 0.25, 1.0, 1e-3, 1e-12])
    trie = NgramTrie(contexts, np.array([3, 4, 5]), np.array([0, 2, 3, 5]), successors, chance)
    at, count = trie.context(np.array([9, 5, 6, 1 << 60], dtype=np.uint64))
    assert at.tolist() == [1, 0, -1, 2] and count.tolist() == [4, 3, 0, 5]
    first, last = trie.ranges(at)
    codes = trie.successor(at, first, last, np.array([7, 7, 7, 7], dtype=np.uint64))
    assert np.allclose(restored(codes), [1.0, 0.25, 0.0, 0.0], rtol=0.05)
    assert (quantised(np.array([1.0, 1e-30])) == [1, 255]).all()
