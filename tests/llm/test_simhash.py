"""Fingerprints, near links and components against brute force."""

import random
import re

import numpy as np
import xxhash
from odd import odd_docs, plain_docs, rows_of

from clickloom.llm import simhash, vptree
from clickloom.llm.components import components
from clickloom.session import staged


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_pairs(codes, reach=4):
    return [(a, b) for i, a in enumerate(codes) for b in codes[:i] if (a ^ b).bit_count() <= reach]


def test_fingerprints_equal_the_definition(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(simhash, "HASHES", 7)
    for n in [0, 1, 3, 4, 5, 40]:
        for _ in range(20):
            text = rng.choice([" ", "\t\n "]).join(rng.choices(["The", "of", "É", "x\x00", "a\xa0b"], k=n))
            assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_tree_places_every_near_pair_once():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    close = codes[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64))
    codes = np.unique(np.concatenate((codes, close, close[:500] ^ np.uint64(7))))
    tree = vptree.VantageTree.build(codes, 10_000_000, 4)
    assert tree.shards > 8
    rows, shard, own = tree.place(codes)
    assert np.array_equal(np.sort(rows[own]), np.arange(len(codes)))
    seen = {}
    for r, s, o in zip(rows.tolist(), shard.tolist(), own.tolist(), strict=True):
        seen.setdefault(s, []).append((r, o))
    met = [tuple(sorted((a, b))) for members in seen.values() for a, o in members if o for b, p in members if a != b and (not p or a < b)]
    assert len(met) == len(set(met))
    near = {(j, i) for i in range(len(codes)) for j in np.flatnonzero(vptree.distance(codes[:i], codes[i]) <= 4)}
    assert near <= set(met)


def test_links_connect_exactly_the_near_codes(spark, monkeypatch):
    rng = random.Random(5)
    codes = [rng.getrandbits(64) for _ in range(400)]
    for c in codes[:40]:
        for _ in range(8):
            for _ in range(rng.choice([1, 3, 5])):
                c ^= 1 << rng.randrange(64)
            codes.append(c)
    codes = sorted({*codes, 0, 1, (1 << 64) - 1})
    monkeypatch.setattr(simhash, "LEAST_BLOCK", 64)
    monkeypatch.setattr(simhash, "MOST_BLOCK", 64)
    monkeypatch.setattr(vptree, "LEAST_SAMPLE", 16)
    monkeypatch.setattr(vptree, "ROW_COST", 0)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    table = staged(spark.createDataFrame(signed, "code long"))
    found = {r["node"]: r["root"] for r in components(simhash.near_links(table)).collect()}
    roots = grouped([s for (s,) in signed], [(a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b) for a, b in near_pairs(codes)])
    assert {n: found.get(n, n) for n in roots} == roots


def test_components_of_a_random_graph(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(7, 7), (None, 3)] + [(1000, i) for i in range(900, 960)]
    links += [(i, i + 1) for i in range(2000, 2040)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None]
    roots = grouped({n for link in real for n in link}, real)
    assert {n: found.get(n, n) for n in roots} == roots
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    roots = grouped({p for _, p in prints}, near_pairs(sorted({p for _, p in prints})))
    heads = {}
    for i, p in prints:
        if i is not None:
            heads[roots[p]] = min(i, heads.get(roots[p], i))
    return sorted(((i, f"{p:016x}", heads.get(roots[p])) for i, p in prints), key=str)


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(rows_of(simhash.near_duplicates(docs)), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert sorted(rows_of(simhash.near_duplicates(docs)), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    empty = plain_docs(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_per_group(empty).count() == 0


def test_one_row_of_each_group_stays_with_all_columns(spark):
    docs = odd_docs(spark)
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    # All texts without words are one group; the two rows of id 4 and id 5 another.
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 4, None, 6, 7], key=str)
