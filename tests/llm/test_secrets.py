"""Base spans against the plain patterns, ownership, masks, odd rows."""

import random
import re

from odd import odd_docs, plain_docs, rows_of

from clickloom.llm import secret_scan
from clickloom.session import staged


def plain_spans(text):
    out = []
    assign = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    for m in re.finditer(assign + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(1)) >= 12:
            out.append((m.start(), 0, m.end(), m.group(1)))
    out += [(m.start(), 1, m.end(), m.group()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end(), m.group()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["token", "Secret", "API_KEY", "apikey", "paſſword", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH0123456789", "0123456789abcdef", "f", "é", "x" * 12, "-", "🙂"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert secret_scan.base_spans(text) == plain_spans(text)


SECRET, COMMON = "q9Zx" + "aB3dE5fG7hJ9kL1m" * 2, "c0mmonEXAMPLEkey1234567890abcd"


def shared_docs():
    rows = [(i, f"see password={COMMON} there", "en", f"s{i}") for i in range(5)]
    return [*rows, (10, f"my {SECRET} here", "en", "s1"), (11, "http://me:hunter22secret@host/", "en", "s2"), (12, "nothing", "en", "s3"), (13, f"password={SECRET}", "en", "s1")]


def test_copied_examples_and_live_secrets(spark):
    found = {r["doc_id"]: r["spans"] for r in secret_scan.scan(plain_docs(spark, shared_docs())).collect()}
    assert [(s["n_owners"], s["n_docs"], s["live"]) for s in found[0]] == [(5, 5, False)]
    assert [(s["kind"], s["n_owners"], s["n_docs"], s["live"]) for s in found[10]] == [(7, 1, 2, True)]
    assert [(s["kind"], s["live"]) for s in found[11]] == [(6, True)]
    assert found[12] == []
    assert [(s["kind"], s["first"] - s["start"]) for s in found[13]] == [(0, len("password="))]


def test_masks_hide_live_secrets_alone(spark):
    docs = plain_docs(spark, shared_docs())
    hidden = {r["doc_id"]: r["text"] for r in secret_scan.masked(docs).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert hidden[0] == before[0] and hidden[12] == before[12]
    assert hidden[10] == f"my {'*' * len(SECRET)} here"
    assert hidden[11] == f"http://me:{'*' * 14}@host/"
    assert hidden[13] == "password=" + "*" * len(SECRET)
    assert {k: len(v) for k, v in hidden.items()} == {k: len(v) for k, v in before.items()}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    found = secret_scan.scan(docs).collect()
    assert len(found) == docs.count() and not any(r["spans"] for r in found)
    assert sorted(rows_of(secret_scan.masked(docs)), key=str) == sorted(rows_of(docs), key=str)
    empty = plain_docs(spark, [])
    assert secret_scan.scan(empty).count() == 0 and secret_scan.masked(empty).count() == 0
    twice = plain_docs(spark, [(None, f"token={SECRET}", None, None)] * 2)
    assert [[(s["n_docs"], s["n_owners"], s["live"]) for s in r["spans"]] for r in secret_scan.scan(twice).collect()] == [[(1, 1, True)]] * 2


def test_many_documents_of_one_source_hold_an_example(spark):
    rng = random.Random(4)

    def prose():
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))

    page = prose()
    rows = [(i, f"{prose()} password={COMMON}", "en", "hot") for i in range(30)]
    rows += [(100 + i, f"{page} password={SECRET} {i}", "en", "hot") for i in range(30)]
    rows += [(200 + i, f"{prose()} token=Few{SECRET}", "en", "hot") for i in range(3)]
    docs = plain_docs(spark, rows)
    found = {r["doc_id"]: r["spans"][0] for r in secret_scan.scan(docs).collect()}
    assert [(found[i]["n_owners"], found[i]["n_docs"], found[i]["live"]) for i in (0, 100, 200)] == [(1, 30, False), (1, 30, True), (1, 3, True)]
    hidden = {r["doc_id"]: r["text"] for r in secret_scan.masked(docs).collect()}
    assert all((COMMON in hidden[i]) and (SECRET not in hidden[100 + i]) for i in range(30))


def test_long_secrets_have_spans():
    rng = random.Random(8)
    token = "aB3" + "".join(rng.choices("abcdefXYZ0123456789", k=997))
    assert [(s, k, e) for s, k, e, _ in secret_scan.added_spans(f"see {token} here", [])] == [(4, 7, 1004)]
    word = "pw-" * 50
    assert [(k, x) for _, k, _, x in secret_scan.added_spans(f"x://{'u' * 65}:{word}@host", [])] == [(6, word)]


def test_a_task_needs_one_python_worker(spark, monkeypatch):
    """Tables that are written without an exchange: each call of Python in their plan is a worker of every task."""
    calls = {}

    def counted(df, name="stage"):
        calls[name] = df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
        return staged(df, name)

    monkeypatch.setattr(secret_scan, "staged", counted)
    docs = plain_docs(spark, shared_docs())
    secret_scan.scan(docs)
    secret_scan.masked(docs)
    assert (calls["spans"], calls["held"]) == (1, 1)
