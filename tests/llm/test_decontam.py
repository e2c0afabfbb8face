"""Matches against a direct search, blocks of the benchmark, odd rows."""

import random
import re

import numpy as np
from odd import odd_docs, plain_docs

from clickloom.llm import decontam
from clickloom.llm.suffixes import suffix_array
from clickloom.session import staged


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def direct(text, items):
    """(words, hit places, items, longest match of at least a window) by comparing every place with every window."""
    w, hit, found, longest = words(text), set(), set(), 0
    for item, other in items:
        x = words(other)
        n = min(13, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                k = 0
                while i + k < len(x) and p + k < len(w) and x[i + k] == w[p + k]:
                    k += 1
                if k >= n:
                    hit |= set(range(p, p + n))
                    found.add(item)
                    longest = max(longest, k)
    return len(w), hit, sorted(found), longest


def flat(spans):
    return {p for s, e in spans for p in range(s, e)}


def made(rng):
    vocabulary = ["a", "B", "é", "x1", "zz"][: rng.choice([1, 2, 5])]
    items = [(str(i), rng.choice([" ", "-"]).join(rng.choices([*vocabulary, "q"], k=rng.choice([0, 1, 3, 13, 14, 20, 40])))) for i in range(rng.randint(1, 4))]
    docs = [" ".join(rng.choices([*vocabulary, "q", "w"], k=rng.choice([0, 1, 5, 14, 60]))) for _ in range(4)]
    return docs + [items[0][1] + " x b", items[-1][1] * 2], items


def test_matches_equal_a_direct_search():
    rng = random.Random(1)
    for _ in range(150):
        docs, items = made(rng)
        built = decontam.Benchmark.build([i for i, _ in items], [t.encode() for _, t in items])
        got = [(n, flat(s), i, d) for n, s, i, d in built.matches([d.encode() for d in docs], rng.choice([1, 50, 1000]))]
        assert got == [direct(d, items) for d in docs]


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50):
        for kinds in (1, 3):
            x = rng.integers(0, kinds, n)
            assert suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_blocks_of_the_benchmark_give_the_same(spark):
    rng = random.Random(4)
    docs, items = made(rng)
    items = [(int(i), t) for i, t in items] + [(9, " ".join("abcdefghijklmnop")), (9, "x y z"), (None, "n u l l"), (7, None)]
    docs += [" ".join("abcdefghijklmnop") + " and x y z n u l l"]
    table = staged(plain_docs(spark, [(i, t, None, None) for i, t in enumerate(docs)]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    text_items = [("" if i is None else str(i), t) for i, t in items]
    want = {i: direct(t, text_items) for i, t in enumerate(docs)}
    for size in (1 << 20, 40):
        met = decontam.with_matches(table, bench, block_bytes=size).select("doc_id", "matches.*", decontam.n_hit().alias("hit")).collect()
        assert {r["doc_id"]: (r["n_words"], flat(r["spans"]), r["items"], r["longest"]) for r in met} == want
        assert all(r["hit"] == len(want[r["doc_id"]][1]) for r in met)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, "same TEXT, in two rows"), (2, "word " * 13)], "item_id long, text string")
    met = decontam.with_matches(docs, bench, into="met").select("doc_id", "text", "matches", "met", decontam.contaminated("met").alias("bad")).collect()
    assert len(met) == docs.count() and {r["matches"] for r in met} == {"matches"}
    for r in met:
        assert r["bad"] == (r["doc_id"] in (4, 5, 6))
    assert [r["met"]["n_words"] for r in met if r["text"] is None] == [0, 0]
    for empty in ([], [(1, None), (2, "")]):
        met = decontam.with_matches(docs, spark.createDataFrame(empty, "item_id long, text string"), into="met").collect()
        assert not any(r["met"]["items"] for r in met)
    assert decontam.with_matches(plain_docs(spark, []), bench).count() == 0
