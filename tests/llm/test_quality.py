"""Counts of texts against a plain version, sketches, thresholds and odd rows."""

import random
import re
from collections import Counter

from odd import CLASH, LONG, odd_docs, plain_docs, rows_of

from clickloom.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered)


def test_counts_like_plain_version():
    rng = random.Random(5)
    texts = ["", " \t\n", "a", "a b c d e f g h", "x " * 9, "a\r\nb\n\na\n a\nb", "über #1 | ſtraße\n漢字 🙂<>\n", "a b\x0bc\x1cd", " ".join("pq"[i % 2] for i in range(40))]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) + rng.choice(["", "\n", "#\n#"]) for _ in range(200)]
    for text in texts:
        assert quality.counts(text.encode()) == plain(text), text


def test_repeated_windows_of_a_long_text():
    assert quality.counts(LONG.encode())[5] == 300_000


def test_thresholds_follow_the_group(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    text = lambda n, extra="": " ".join(word(n) + extra for _ in range(40))
    # Symbols are usual in one source and odd in the other.
    rows = [(i, text(5), "en", "prose") for i in range(150)] + [(200 + i, text(5, "|"), "en", "tables") for i in range(150)]
    rows += [(900, text(4, "|"), "en", "prose"), (901, text(30), "en", "prose"), (902, text(1), "en", "prose")]
    rows += [(903, text(5), None, None), (904, text(5), "en", "rare")]
    told = {r["doc_id"]: r for r in quality.judge(plain_docs(spark, rows)).collect()}
    assert [told[i]["beyond"] for i in (900, 901, 902)] == ["symbols", "word_length", "word_length"]
    assert all(told[i]["kept"] for i in told if i not in (900, 901, 902))


def test_sketches_merge_to_the_sketch_of_all(spark):
    rows = spark.createDataFrame([("en", "a" if i % 3 else "b", i * i, None, 0, 5) for i in range(400)], "lang string, source string, symbols long, dup_lines long, repeats long, word_length long")
    told = {(r["level"], r["lang"], r["source"], r["measure"]): r for r in quality.quartiles(quality.sketch(rows)).collect()}
    whole = told[2, "", "", "symbols"]
    assert whole["docs"] == 400 and told[0, "en", "a", "symbols"]["docs"] == 266
    for q in quality.QUARTILES:
        exact = sorted(i * i for i in range(400))[4 * q - 1]
        assert exact * 127 / 128 <= whole[f"q{q}"] <= exact
    assert not any(measure == "dup_lines" for *_, measure in told)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    told = quality.judge(docs)
    assert told.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "beyond"]
    found = rows_of(told)
    assert len(found) == docs.count() and all(r[6] and not r[7] and r[8] == "" for r in found)  # short, or repeats only
    assert rows_of(quality.judge(docs.where("false"))) == []


def test_filter_keeps_rows_as_they_are(spark):
    word = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    docs = odd_docs(spark, [(i, word(i), "en", "a") for i in range(20)] + [(50, "short", "en", "a"), (None, None, None, None)])
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and {r[0] for r in rows_of(kept)} == set(range(20))
    assert rows_of(kept)[0][4:] == tuple(CLASH)
