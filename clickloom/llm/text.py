"""Word rules, held-out splits and small helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def _table(separators: bytes) -> bytes:
    """A translation of bytes: A-Z to lower case, separators to a space, anything else as it is."""
    table = bytearray(bytes.maketrans(UPPER, UPPER.lower()))
    for byte in separators:
        table[byte] = 0x20
    return bytes(table)


# Words without white space, and words without any ASCII but letters and digits.
SPACED = _table(SPACE)
ALNUM = _table(bytes(b for b in range(128) if not chr(b).isalnum()))

# Texts of a batch that are held as bytes at once.
AT_ONCE = 256

# A text is cut into pieces of about this many bytes, so that its list of words stays small.
PIECE_BYTES = 1 << 20


def pieces_of_words(data: bytes, table: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in order, as one list per piece; no word is cut."""
    plain = data.translate(table)
    start, end = 0, len(plain)
    while start < end:
        stop = plain.find(b" ", start + size)
        stop = end if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


def utf8(texts: pa.Array) -> list[bytes]:
    """The bytes of each text; a null is an empty text."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def each_utf8(texts: pa.Array) -> Iterator[bytes]:
    """As ``utf8``, one text after the other, so that a worker doesn't hold a batch a second time."""
    for at in range(0, len(texts), AT_ONCE):
        yield from utf8(texts.slice(at, AT_ONCE))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(modulus))


def sample_below(key: Column, rows: int, bound: int, seed: int = 0) -> Column:
    """True for about ``bound`` of ``rows`` keys, the same ones whenever it is asked."""
    if rows <= bound:
        return F.lit(True)
    grain = 1 << 30
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(grain)) < int(grain * bound / rows)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
