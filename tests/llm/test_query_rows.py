"""Every corpus query without SQL is run on the given tables; the columns that its contract fixes are compared with plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from clickloom.llm import queries

# Models learn too little from the 200 documents of the smallest tables.
LARGER = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def result(spark, sf_dir):
    known = {}

    def rows(name):
        if name not in known:
            known[name] = {r["doc_id"]: r.asDict() for r in queries.QUERIES[name](spark, sf_dir).collect()}
        return known[name]

    return rows


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_simhash(documents, result):
    codes = {}
    for d in documents:
        w = words(lower(d["text"]))
        parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        codes[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    own = {i: i for i in codes}
    for _ in codes:
        before = dict(own)
        for i, a in codes.items():
            own[i] = min(own[j] for j, b in codes.items() if (a ^ b).bit_count() <= 4)
        if own == before:
            break
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in result("op1_simhash").items()} == {i: (f"{codes[i]:016x}", own[i]) for i in codes}


def test_toxicity(spark):
    told = {r["doc_id"]: r for r in queries.QUERIES["op2_toxicity"](spark, LARGER).collect()}
    assert set(told) == {r[0] for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id").collect()}
    assert all(r["held_out"] == (crc(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in told.items())
    toxic = {r[0]: r[1] for r in spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic").collect()}
    seen = [i for i in told if toxic.get(i) is not None]
    assert sum(told[i]["predicted"] == toxic[i] for i in seen) >= 0.95 * len(seen)


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16])


def test_secrets(documents, result):
    told, some = result("op4_secret_scan"), Counter()
    for d in documents:
        spans, r = base(d["text"]), told[d["doc_id"]]
        names = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans]
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert not Counter(names) - Counter(r["spans"].split(","))
        some.update({i: bool(c) for i, c in enumerate(counts)})
    assert sum(map(bool, some.values())) >= 1


def test_counts_of_kinds_differ(spark, tmp_path):
    key, access = "a1b2c3d4e5f60718", "AKIA" + "Z9" * 8
    texts = [f"{key} {key} {key}", f"password = Zq8sLk3jQw7dPx {access}", f"{access} {key} token:abcdefghijkl2 secret='mnopqrstuvwx'", "", None]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    told = queries.QUERIES["op4_secret_scan"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["n_assign"], r["n_access"], r["n_hex"]) for r in told] == [(0, 0, 3), (1, 1, 0), (2, 1, 1), (0, 0, 0), (0, 0, 0)]


def test_language(documents, result):
    told, learned = result("op5_langid"), {d["lang"] for d in documents if d["lang"] and crc(d["doc_id"], 4) != 2}
    for d in documents:
        r = told[d["doc_id"]]
        assert r["held_out"] == (crc(d["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned | {"und"}
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
    held = [d for d in documents if d["lang"] and crc(d["doc_id"], 4) == 2]
    assert sum(told[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.95 * len(held)


def test_language_model(documents, result):
    told = result("op7_ngram_lm")
    tokens = {d["doc_id"]: [*words(lower(d["text"])), None] for d in documents}
    counts = Counter(t for i, own in tokens.items() if crc(i, 7) != 2 for t in own)
    total, kinds = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = told[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 7) == 2, len(own), sum(counts[t] > 0 for t in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in own), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] <= 0


def test_language_model_beats_single_words(spark):
    held = [r for r in queries.QUERIES["op7_ngram_lm"](spark, LARGER).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.7 * len(held)


def test_token_counts(documents, result):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    told = result("op8_token_counts")
    for d in documents:
        n = len(library.encode(d["text"] or "", add_special_tokens=False).ids)
        r = told[d["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((d["text"] or "").encode()), n, n > 1024)


def test_mixing(documents, result):
    told = result("op9_mixing")
    size = {d["doc_id"]: len(words(d["text"])) for d in documents}
    sources = sorted({d["source"] for d in documents}, key=lambda s: (s is None, s))
    own = {s: sum(size[d["doc_id"]] for d in documents if d["source"] == s) for s in sources}
    weight, target, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, {}, sum(own.values())
    left = list(sources)
    while left:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * own[s]]
        target.update({s: 3 * own[s] for s in over} or share)
        left = [s for s in left if s not in target]
    taken = Counter()
    for d in documents:
        r = told[d["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[d["doc_id"]], own[d["source"]]) and r["target"] == pytest.approx(target[d["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= min(largest, 0.05 * target[s] + 100) for s in sources)


def test_every_query_has_its_columns(spark, sf_dir):
    wanted = {"op3_topk": ["query_id", "rank", "vec_id", "score"], "op6_decontam": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op10_url_filter": ["page_id", "host", "path", "rule", "verdict"]}
    for name, columns in wanted.items():
        assert queries.QUERIES[name](spark, sf_dir).columns[: len(columns)] == columns, name
