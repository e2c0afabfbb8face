"""Counts against the library."""

import random

import public_tokenizers
import pytest
from odd import odd_docs, plain_docs
from tokenizers import Tokenizer

from clickloom.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def length(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_pre_tokens_and_pieces(library, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 7)
    counter = token_counts.PieceCounter(open(PATH, encoding="utf-8").read())
    rng = random.Random(2)
    letters = [chr(c) for c in [*range(128), *range(128), *range(0xA0, 0x250), 0x2028, 0x3000, 0x4E00, 0x1F600, 0x85, 0x558, 0xB2, 0x208F, 0x10940]]
    letters += ["  ", "\n\n", " '", "'s", "'ll", "don't", " the", " a ", "12"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert sum(counter.pieces(t) for part in counter.pre_tokens(text) for t in part) == length(library, text)


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for size in (token_counts.blocks.BLOCK_BYTES, 20_000):
        got = token_counts.count_tokens(docs.repartition(3), PATH, block_bytes=size).collect()
        assert len(got) == len(texts)
        assert all((r["n_bytes"], r["n_tokens"]) == (len(texts[r["doc_id"]].encode()), length(library, texts[r["doc_id"]])) for r in got)


def test_odd_rows(spark, library):
    extra = [(20, "a<|endoftext|>b <|endoftext|>", None, None), (21, "don't  stop\n\n now ", None, None)]
    docs = odd_docs(spark, [*token_rows(), *extra])
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), length(library, r["text"])) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, PATH).collect()) == want
    assert token_counts.count_tokens(plain_docs(spark, []), PATH).count() == 0


def token_rows():
    from odd import ODD

    return ODD


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.PieceCounter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
