"""The automaton against edit distances, contexts, accuracy on held-out texts, odd rows."""

import random

from odd import odd_docs, plain_docs
from pyspark.sql import functions as F

from clickloom.llm import toxicity
from clickloom.llm.text import remainder
from clickloom.llm.toxicity import Automaton, contexts


def edits(a, b):
    """Insertions, deletions, replacements and swaps of neighbours, each place edited once."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            best = min(rows[i][j] + (x != y), rows[i][j + 1] + 1, new[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, rows[i - 1][j - 1] + 1)
            new.append(best)
        rows.append(new)
    return rows[-1][-1]


def test_automaton_equals_edit_distances(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_STATES", 20)
    rng = random.Random(0)
    for _ in range(400):
        entries = [(e, rng.random() < 0.4) for e in sorted({"".join(rng.choices("abc", k=rng.randint(2, 10))) for _ in range(4)})]
        automaton = Automaton(entries)
        for _ in range(5):
            word = "".join(rng.choices("abc", k=rng.randint(1, 11)))
            found = {}
            for i, (e, stem) in enumerate(entries):
                d = min(edits(e, word[:n]) for n in range(len(word) + 1)) if stem else edits(e, word)
                if d <= (0 if len(e) < 5 else 1 if len(e) < 8 or stem else 2):
                    found[i] = d
            best = min(found, key=lambda i: (found[i], -len(entries[i][0]), i), default=None)
            assert automaton.best(word) == (None if best is None else (best, found[best]))


def test_usual_misspellings():
    automaton = Automaton([("idiot", False), ("scumbag", False), ("worthless", False), ("imbecil", True)])

    def found(text):
        return [(entry, k) for entry, k, _ in contexts(text, automaton, {})]

    for word in ("id1ot", "idi0t", "idoit", "idiiot", "idot", "1diot", "ID!OT", "id*ot", "id_iot"):
        assert found(f"you {word}, you") == [(0, 1)], word
    for word in ("sc*mbag", "scmubag", "$cumbag", "scumbaag"):
        assert found(word) == [(1, 1)], word
    for word in ("imbecilles", "imb3cil", "ibmecile", "imbec*lity"):
        assert [e for e, _ in found(word)] == [3], word
    for word in ("w0rthl3ss", "owrthelss", "worthles5", "wort#less"):
        assert [e for e, _ in found(word)] == [2], word
    for text in ("idiot2", "@idiot", "my*idiot", "idiot!!!", "%%%idiot%%%", "x_idiot"):
        assert found(text) == [(0, 0)], text
    for text in ("", "id", "1d10t", "!!!", "is it", "idiom riot", "scum"):
        assert 0 not in [k for _, k in found(text)], text
    assert found("1d10t !!! riot scum") == []


def test_quoted_and_plain_hits():
    automaton, reporting = Automaton([("wretch", False)]), frozenset({"wrote"})
    assert contexts('You WRETCH, you wretsch', automaton, {}, reporting) == [(0, 0, False), (0, 1, False)]
    assert contexts('the line was "that wretch there" again', automaton, {}, reporting) == [(0, 0, True)]
    assert contexts("he wrote wretch on it", automaton, {}, reporting) == [(0, 0, True)]
    assert contexts("nothing of that kind", automaton, {}, reporting) == []


def test_reporting_words_are_learned_in_any_language(spark):
    rng = random.Random(2)
    filler = ["".join(rng.choices("aeioumnr", k=6)) for _ in range(200)]
    rows, marks = [], []
    for i in range(400):
        around = [" ".join(rng.sample(filler, 5)) for _ in range(2)]
        if i % 8 == 0:
            rows.append((i, f"{around[0]} blockheads {around[1]}"))
        elif i % 20 == 1:
            rows.append((i, f"{around[0]} schrieb blockheads {around[1]}"))
        else:
            rows.append((i, " ".join(around)))
        marks.append((i, int(i % 8 == 0)))
    # Many toxic texts, so that some clean ones with the word still leave it an entry.
    rows += [(1000 + i, "blockheads " + " ".join(rng.sample(filler, 6))) for i in range(160)]
    marks += [(1000 + i, 1) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True))
    assert [e for e, _ in model.entries] == ["blockheads"] and model.reporting == {"schrieb"}
    told = spark.createDataFrame([(1, "er schrieb blockheads hin"), (2, "ihr blockheads"), (3, "ihr b1ockhaeds")], "doc_id long, text string")
    score = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.with_toxicity(told, model).collect()}
    assert score[1] < 0.5 < min(score[2], score[3])


def labelled(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs, spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_held_out_texts(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.01")
    model = toxicity.learn(docs, labels, remainder("doc_id", 3) != 1)
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(remainder("doc_id", 3) == 1)
    scored = toxicity.with_toxicity(held, model).collect()
    flagged = [r["toxic"] for r in scored if r["toxicity"]["score"] >= toxicity.THRESHOLD]
    # Eleven training texts in other languages are too few to learn their words from.
    assert sum(flagged) >= 0.7 * sum(r["toxic"] for r in scored)
    assert len(flagged) - sum(flagged) <= 1


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1), (4, 0), (2, 0), (1, None), (None, 1), (6, 0), (7, 5)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        model = toxicity.learn(docs, marks, remainder("doc_id", 3) != 1)
        scored = toxicity.with_toxicity(docs, model).collect()
        assert len(scored) == docs.count()
        assert all(0 <= r["toxicity"]["score"] <= 1 for r in scored)
        assert {r["score"] for r in scored} == {"score"}
    assert toxicity.with_toxicity(plain_docs(spark, []), model).count() == 0
