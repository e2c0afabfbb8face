"""Vocabulary, near words and forms against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from odd import odd_docs, plain_docs, rows_of

from clickloom.llm import spelling


def plain_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=10):
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best and words[best] >= ratio * n else None, n, len(near)]
    rows = []
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, near, words[form] if form else None))
    return sorted(rows)


def vocabulary(rng, size, alphabet):
    words = {}
    while len(words) < size:
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(7, 11)))
        for _ in range(4):
            words[w] = rng.choice([2, 3, 30, 400, 5000])
            i, c = rng.randrange(len(w)), rng.choice(alphabet)
            w = rng.choice([w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w + c, w[:i] + w[i + 1 :] if len(w) > 7 else w])
    return words


def as_docs(words):
    """Documents that hold each word as often as it says; ids avoid the deletion."""
    return [(i, (w + " ") * n) for w, n in words.items() for i in [next(i for i in range(99) if zlib.crc32(f"{i}:{w}".encode()) % 31)]]


def found(spark, rows, **more):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    return sorted(tuple(r) for r in spelling.variants(docs, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_forms_like_plain_version(spark):
    words = vocabulary(random.Random(2), 300, "abcß")
    assert found(spark, as_docs(words)) == plain(words)


def test_large_halves_are_cut_into_pieces(spark):
    words = vocabulary(random.Random(3), 250, "ab")
    assert found(spark, as_docs(words), cell=16) == plain(words)


def test_roots_follow_forms(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 25, "aaaaabb": 300, "aaaabbb": 3000, "aaabbbb": 40000}
    told = found(spark, as_docs(words))
    assert told == plain(words) and {r[2] for r in told} == {"aaabbbb"}


def test_deleted_letters_and_letters_beyond_ascii(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(60)]), " ".join(rng.choice(["ÉTÉétéÀÿ", "Informationen", "Straßenname", "x×÷yÀÀÀÀÀ", "ſhortlong", "abc_defghijk1lmnopqr", "naïveté"]) for _ in range(30))) for _ in range(200)]
    told = found(spark, rows)
    assert told == plain(plain_words(rows)) and any(r[1] for r in told)


def test_index_finds_exactly_one_error():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(3, 9))) for _ in range(200)}, key=len)
    index = spelling.PositionIndex(words)
    for length in range(1, 11):
        asked = ["".join(rng.choice("ab") for _ in range(length)) for _ in range(20)]
        letters = np.array([[ord(c) - 97 for c in w] for w in asked])
        pairs = {(asked[r], words[w]) for rows, held in index.near(letters) for r, w in zip(rows, held, strict=True)}
        assert pairs == {(a, w) for a in asked for w in words if one_apart(a, w)}


def test_very_long_runs(spark):
    words = {"ab" * 20_000: 2, "ab" * 20_000 + "b": 30, "b" * 40_000: 2}
    assert found(spark, as_docs(words)) == plain(words)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    told = spelling.variants(docs)
    assert told.columns == ["word", "form", "root", "n", "n_near", "form_n"] and rows_of(told) == []
    texts = [(None, "strasse Strasse"), (1, None), (2, ""), (2, "Strasse"), (2, "Strasse")]
    assert {r[0]: r[3] for r in rows_of(spelling.variants(odd_docs(spark, [(*t, None, None) for t in texts])))} == plain_words(texts)
    assert rows_of(spelling.variants(plain_docs(spark, []))) == []
