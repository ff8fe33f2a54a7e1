"""Tokens as column expressions, and the same tokens of whole batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import rules


def token_pattern(terms: list[str], han: str) -> str:
    """Protected terms whole, then runs of letters, single CJK characters, runs of digits; han is an engine's name of the CJK class."""
    whole = "|".join(sorted(terms, key=len, reverse=True))
    return f"({whole + '|' if whole else ''}\\p{{{han}}}|[^\\P{{L}}\\p{{{han}}}]+|[0-9]+)"


def tokenize(c: Column, terms: list[str] = ()) -> Column:
    """Lower-cased tokens of a text in any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(token_pattern(terms, "IsHan")), 1)


def words(c: Column) -> Column:
    """The tokens that searches use, with the domain's terms whole."""
    return tokenize(c, rules.TERMS)


LETTER, DIGIT, HAN = 1, 2, 3


def code_points(spark: SparkSession) -> np.ndarray:
    """LETTER, DIGIT, HAN or 0 of each code point, as Spark's own patterns have it."""
    step = 4096
    rows = [(lo, "".join(" " if 0xD800 <= i < 0xE000 else chr(i) for i in range(lo, lo + step))) for lo in range(0, 0x110000, step)]
    s = F.regexp_replace("s", r"[^\p{L}\p{IsHan}0-9]", " ")
    for pattern, one in ((r"\p{IsHan}", "!"), (r"\p{L}", "a"), (r"[0-9]", "0")):
        s = F.regexp_replace(s, pattern, one)
    found = "".join(r["s"] for r in spark.createDataFrame(rows, "lo int, s string").select("lo", s.alias("s")).orderBy("lo").collect())
    kinds = np.zeros(128, np.uint8)
    kinds[[ord(c) for c in "a0!"]] = LETTER, DIGIT, HAN
    return kinds[np.frombuffer(found.encode(), np.uint8)]


def _kinds(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 belongs to."""
    kinds = np.where(np.arange(256) < 128, table[:256], 0).astype(np.uint8)[data]
    lead = np.flatnonzero(data >= 0xC0)
    more = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    point = data[lead] & np.array([0, 0x1F, 0x0F, 0x07], np.uint32)[more]
    for i in (1, 2, 3):
        has = more >= i
        point[has] = point[has] << 6 | data[lead[has] + i] & 0x3F
    kind = table[point]
    kinds[lead] = kind
    for i in (1, 2, 3):
        kinds[lead[more >= i] + i] = kind[more >= i]
    return kinds


def cut(texts: pa.Array, table: np.ndarray, terms: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The tokens that tokenize() finds in lower-cased texts, and how many each text has; table is code_points(), terms are of
    CJK characters alone."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends, kinds = ends - ends[0], _kinds(data, table)
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kinds[1:] != kinds[:-1]
    new[ends] = True
    new = new[:-1] & (kinds > 0) | (kinds == HAN) & (data >= 0xC0)
    if (kinds == HAN).any():
        raw, places, done = data.tobytes(), [], 0
        for term in (t.encode() for t in terms):
            at = raw.find(term)
            while at >= 0:
                places.append((at, -len(term)))
                at = raw.find(term, at + 1)
        for at, size in sorted(places):  # the first one, and of those that begin alike the longest, as the pattern takes them
            if at >= done and at - size <= ends[np.searchsorted(ends, at, "right")]:
                done = at - size
                new[at + 1 : done] = False
    starts, kept = np.flatnonzero(new), kinds > 0
    out = np.ascontiguousarray(data[kept])
    offsets = np.append(np.cumsum(kept)[starts] - 1, len(out)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)]), np.diff(np.searchsorted(starts, ends))
