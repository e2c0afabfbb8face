"""Code lengths against a direct recursion, accuracy on held-out texts, odd rows."""

import math
from collections import Counter

import numpy as np
from odd import odd_docs, plain_docs

from clickloom.llm import langid
from clickloom.llm.hashing import KeyTable
from clickloom.llm.text import remainder


def direct_bits(train, text, order):
    """Code length of a text by the recursion, from the counts of the training texts."""
    seen = [Counter() for _ in range(order + 1)]
    for t in train:
        padded = bytes(order) + t.lower()
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[k][padded[i - k : i], padded[i]] += 1
    total, kinds = Counter(), Counter()
    for counts in seen:
        for (context, _), n in counts.items():
            total[context] += n
            kinds[context] += 1

    def cost(context, byte):
        below = cost(context[1:], byte) if context else 8.0
        if not total[context]:
            return below
        n = seen[len(context)][context, byte]
        whole = total[context] + kinds[context]
        return math.log2(whole / n) if n else math.log2(whole / kinds[context]) + below

    padded = bytes(order) + text.lower()
    return sum(cost(padded[i - order : i], padded[i]) for i in range(order, len(padded)))


def test_bits_equal_the_recursion(monkeypatch):
    train = {"x": [b"abracadabra", b"Abba"], "y": [b"banana band", b""]}
    for order in (2, 3, 4):
        counts = []
        for texts in train.values():
            counts.append(np.unique(np.concatenate([langid._grams(t.lower(), order) for t in texts]), return_counts=True))
        trees = langid.ContextTrees.learn(list(train), counts, order)
        texts = [b"abra", b"BANANA", b"", b"zq\x00\xff", b"aban" * 30]
        want = [[direct_bits(t, text, order) for t in train.values()] for text in texts]
        for positions in (1 << 18, 5):
            monkeypatch.setattr(langid, "POSITIONS", positions)
            assert np.allclose(trees.bits(texts), want, rtol=1e-5)


def test_key_table_finds_all_and_only_its_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000))
    table = KeyTable(keys)
    assert np.array_equal(table.find(keys), np.arange(len(keys)))
    assert (table.find(keys[:100] + (1 << 41)) == -1).all()
    assert (KeyTable(keys[:0]).find(keys) == -1).all()


def test_held_out_texts_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = langid.learn(docs.where(remainder("doc_id", 4) != 2))
    told = langid.with_language(docs.where(remainder("doc_id", 4) == 2), trees).collect()
    right = sum(r["lang"] == r["language"]["lang_pred"] for r in told)
    assert right >= 0.95 * len(told) > 0
    assert all(0 <= r["language"]["score"] <= 1 for r in told)


def test_a_bounded_sample_learns_every_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = langid.learn(docs, rows=40)
    assert trees.langs == sorted(r[0] for r in docs.select("lang").distinct().collect())


def test_odd_rows(spark):
    docs = odd_docs(spark)
    told = langid.with_language(docs, langid.learn(docs), into="told").select("doc_id", "text", "language", "told", langid.is_language("told").alias("ok")).collect()
    assert len(told) == docs.count()
    for r in told:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["told"]["lang_pred"] == "und") == (not letters)
        assert r["language"] == "language" and (r["ok"] or not letters or len(r["text"]) < 60)
    nothing = langid.learn(plain_docs(spark, []))
    told = langid.with_language(docs, nothing, into="told").collect()
    assert {(r["told"]["lang_pred"], r["told"]["score"]) for r in told} == {("und", 0.0)}
