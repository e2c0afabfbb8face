"""Secret scans that weigh candidates by how many owners hold them.

Base patterns always count. Further candidates (provider keys, signed tokens, key blocks, passwords in
addresses, strings that look random) are hashed, and the hashes are counted over the whole corpus by distinct
documents and distinct owners. What many owners hold is a copied example, and so is what a few owners hold in
many documents, unless these are near copies of each other; what is specific to an owner looks live and is added.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.simhash import classes, fingerprint
from clickloom.llm.text import each_utf8
from clickloom.session import discard, staged

# A secret that more owners than this hold is a copied example.
MOST_OWNERS = 2
# So is one that more documents than this hold, near copies counted once.
MOST_DOCS = 8
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# Public formats of further credentials, in the order in which spans with one start are listed.
ADDED = {
    "provider": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})"),
    "signed": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "block": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}"),
    "address": re.compile(r"://[^\s/:@]+:([^\s/@]{6,})@"),
    "random": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])"),
}
# Without one of these a text can't match the pattern.
NEEDED = {
    "provider": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk_live_"),
    "signed": ("eyJ",),
    "block": ("-----BEGIN",),
    "address": ("://",),
    "random": "0123456789",
}
ORDER = ("assign", "access", "hex", *ADDED)
BITS = 3.5
SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "kind", "end", "first")] + [T.StructField("hash", T.StringType())])
_CODED = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("code", T.LongType())])
_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end", "first")] + [("hash", pa.string())]))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) of the base patterns, in code points, in order."""
    out = []
    lower = text.encode().lower()
    if any(n in lower for n in NAMES):
        out += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if b"akia" in lower:
        out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates of the further formats that don't overlap a span listed before them."""
    starts, ends = _joined(base)
    out = []
    for kind, (name, pattern) in enumerate(ADDED.items(), 3):
        if not any(n in text for n in NEEDED[name]):
            continue
        for m in pattern.finditer(text):
            group = 1 if name == "address" else 0
            start, end = m.span(group)
            secret = m.group(group)
            if name == "random" and not _looks_random(secret):
                continue
            at = bisect_right(ends, start)  # the first taken range that ends after this start
            if at == len(starts) or end <= starts[at]:
                starts.insert(at, start)
                ends.insert(at, end)
                out.append((start, kind, end, secret))
    return out


def _joined(spans: list[tuple[int, int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the ranges that spans, given in order, cover."""
    starts, ends = [], []
    for start, _, end, _ in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _looks_random(secret: str) -> bool:
    """Lower and upper case and digits, with a high entropy of characters."""
    if not (re.search("[a-z]", secret) and re.search("[A-Z]", secret) and re.search("[0-9]", secret)):
        return False
    n = len(secret)
    return -sum(c / n * math.log2(c / n) for c in Counter(secret).values()) >= BITS


def _found(data: bytes) -> list[dict]:
    text = data.decode()
    base = base_spans(text)
    spans = sorted(base + added_spans(text, base))
    return [{"start": s, "kind": k, "end": e, "first": e - len(x), "hash": hashlib.sha256(x.encode()).hexdigest()} for s, k, e, x in spans]


@F.arrow_udf(T.ArrayType(SPAN))
def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([_found(data) for data in each_utf8(texts)], _SPANS)


@F.arrow_udf(_CODED)
def _scan_coded(texts: pa.Array) -> pa.Array:
    rows, codes = [], []
    for data in each_utf8(texts):
        rows.append(_found(data))
        codes.append(fingerprint(data) if rows[-1] else 0)
    columns = [pa.array(rows, _SPANS), pa.array(np.array(codes, dtype=np.uint64).view(np.int64))]
    return pa.StructArray.from_arrays(columns, names=_CODED.fieldNames())


def candidates(text: str | Column) -> Column:
    """Spans (start, kind as a place in ORDER, end, first of the secret, its sha256) of all patterns, by start, then kind."""
    return _scan.asNondeterministic()(text)


def _coded(text: str | Column) -> Column:
    """The candidates with the ``simhash`` of a text that has any, 0 for the others.

    In one call: of two in a row each runs in a Python worker of its own, and an executor keeps all its workers.
    """
    return _scan_coded.asNondeterministic()(text)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_docs, n_owners): in how many distinct documents and with how many distinct owners a secret occurs.

    ``found`` has the columns hash, doc and owner. A null document or owner counts as one of its own.
    """
    present = F.struct(F.col("doc").isNull().alias("absent"), F.coalesce(F.col("doc").cast("string"), F.lit("")).alias("key"))
    owner = F.struct(F.col("owner").isNull().alias("absent"), F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("key"))
    counted = found.groupBy("hash").agg(F.count_distinct(present).alias("n_docs"), F.count_distinct(owner).alias("n_owners"))
    return staged(counted, "owners")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """A row per document: doc_id and ``spans``, an array of (start, kind, end, first, hash, n_docs, n_owners, live).

    Spans are in code points, by start, then kind. ``live`` holds for a secret that at most MOST_OWNERS owners
    have, in at most MOST_DOCS documents; near copies (the rule of ``simhash``) count as one document there, but
    not in ``n_docs``. Null and empty texts have no spans. Repeated rows give repeated rows, and their secrets count once
    per distinct id and owner. Other columns aren't read; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(owner).alias("owner"), _coded(F.col(text)).alias("found"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    rows = staged(rows.select("at", "doc", "owner", "found.*"), "spans")
    judged = _judged(rows)
    none = F.array().cast("array<struct<start: int, kind: int, end: int, first: int, hash: string, n_docs: bigint, n_owners: bigint, live: boolean>>")
    clean = rows.where(F.size("spans") == 0).select(F.col("doc").alias(doc_id), none.alias("spans"))
    held = rows.where(F.size("spans") > 0).select("at", F.col("doc").alias(doc_id)).join(judged, "at").select(doc_id, "spans")
    return clean.unionByName(held)


def _judged(rows: DataFrame) -> DataFrame:
    """(at, spans) for the written rows (at, doc, owner, spans, code) that have any."""
    found = rows.select("at", "doc", "owner", F.explode("spans").alias("s")).select("at", "doc", "owner", "s.*")
    owners = ownership(found)
    copied = _copied(rows, owners)
    if copied is not None:
        owners = owners.join(copied.hint("merge"), "hash", "left")
    live = (F.col("n_owners") <= MOST_OWNERS) & (F.lit(True) if copied is None else F.col("copied").isNull())
    met = found.join(owners, "hash")
    span = F.struct("start", "kind", "end", "first", "hash", "n_docs", "n_owners", live.alias("live"))
    return staged(met.groupBy("at").agg(F.array_sort(F.collect_list(span)).alias("spans")), "judged")


def _copied(rows: DataFrame, owners: DataFrame) -> DataFrame | None:
    """(hash, copied) of secrets that few owners hold in many documents that aren't near copies; None if none has many."""
    wide = owners.where((F.col("n_owners") <= MOST_OWNERS) & (F.col("n_docs") > MOST_DOCS)).select("hash")
    if wide.isEmpty():
        return None
    held = rows.select("code", F.explode("spans.hash").alias("hash")).distinct()
    held = staged(held.join(wide, "hash", "left_semi"), "held")
    groups = classes(held.select("code", F.col("code").alias("doc_id")))
    counted = held.join(groups.select("code", "root"), "code").groupBy("hash").agg(F.count_distinct("root").alias("n"))
    out = staged(counted.where(F.col("n") > MOST_DOCS).select("hash", F.lit(True).alias("copied")), "copied")
    discard(held, groups)
    return out


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """``docs`` with every live secret overwritten by asterisks, one for each character; copied examples stay.

    All rows and columns come back, whatever their names; only the rows with candidates are shuffled.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    clean = rows.withColumn("spans", candidates(F.col(f"row.`{text}`"))).where(F.size("spans") == 0).select("row.*")
    held = rows.withColumn("found", _coded(F.col(f"row.`{text}`"))).where(F.size("found.spans") > 0).withColumn("at", F.monotonically_increasing_id())
    held = staged(held.select("at", F.col(f"row.`{doc_id}`").alias("doc"), F.col(f"row.`{owner}`").alias("owner"), "found.*", "row"), "held")
    judged = _judged(held.select("at", "doc", "owner", "spans", "code"))
    live = judged.select("at", F.filter("spans", lambda s: s["live"]).alias("live"))
    out = held.join(live, "at").withColumn("hidden", _mask(F.col(f"row.`{text}`"), F.transform("live", lambda s: F.array(s["first"], s["end"]))))
    columns = [F.col("hidden").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    return clean.unionAll(out.select(*columns))


@F.arrow_udf(T.StringType())
def _mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, ranges in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        pieces, done = [], 0
        for start, end in sorted(ranges):
            pieces += [text[done:start], "*" * (end - max(start, done))]
            done = max(done, end)
        out.append("".join([*pieces, text[done:]]))
    return pa.array(out, pa.string())


def listed(spans: str | Column, keep=lambda s: F.lit(True)) -> Column:
    """kind:start:end of the spans that ``keep`` holds for, comma-joined."""
    names = F.array(*(F.lit(n) for n in ORDER))
    text = F.transform(F.filter(spans, keep), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(text, ",")
