"""Chunking: sections by headings, blocks, packed paragraphs. Built-in expressions where a step is stateless over the row;
the state machines of a document run as a small generator in tasks, one document at a time, and nothing shuffles."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.clean import clean_text, strip
from ..functions.meta import extract_metadata
from ..functions.structure import mark_structures

#: A task holds chunks of about so many characters at once.
CHARS = 1 << 20
_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*")
CHUNK = "section int, block int, piece int, chunk_index int, content_type string, heading_path string, heading_level int, table_columns array<string>, content string"


def _names() -> list[str]:
    return [f.split()[0] for f in CHUNK.split(", ")]


def hard_split(c: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of `size` characters, each `size - overlap` after the last, up to the one that reaches the end; no blank ones."""
    step, n = max(size - overlap, 1), F.char_length(c)
    count = F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0))
    return F.filter(F.transform(F.sequence(F.lit(0), count), lambda i: F.substring(c, i * step + 1, F.lit(size))), lambda p: strip(p) != "")


def table_columns(c: Column) -> Column:
    """The names in a Markdown table's first line."""
    head = F.get(F.split(strip(c), "\n"), F.lit(0))
    return F.filter(F.transform(F.split(head, r"\|", -1), lambda x: strip(x)), lambda x: (x != "") & (x != "---") & F.contains(head, F.lit("|")))


def sections(text: str) -> Iterator[tuple[list[str], str]]:
    """(titles from the outermost heading, body) of each section with a body."""
    path: list[tuple[int, str]] = []
    body: list[str] = []
    for line in [*text.split("\n"), None]:
        mark = _HEADING.fullmatch(line.strip()) if line is not None else None
        if line is not None and not mark:
            body.append(line)
            continue
        if whole := "\n".join(body).strip():
            yield [t for _, t in path], whole
        if mark:
            level = len(mark[1])
            path, body = [p for p in path if p[0] < level] + [(level, mark[2].strip())], []


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """(kind, lines) of text, table and code blocks in their order; an open block ends with the text."""
    kind, held = "text", []
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("|") and s.endswith("|"):
            turn = "table"
        elif s.startswith("```"):
            if kind == "code":
                yield "code", "\n".join([*held, line])
                kind, held = "text", []
                continue
            turn = "fence"
        else:
            turn = "code" if kind == "code" else "text"
        if turn != kind:
            if held:
                yield kind, "\n".join(held)
            held, kind = [], "code" if turn == "fence" else turn
        held.append(line)
    if held:
        yield kind, "\n".join(held)


def _windows(text: str, size: int, overlap: int) -> list[str]:
    step = max(size - overlap, 1)
    last = max(0, -(-(len(text) - size) // step))
    return [p for i in range(last + 1) if (p := text[i * step : i * step + size]).strip()]


def _reach(ends: list[int], i: int, room: int) -> int:
    """The end of the longest run of parts from i that fits into room; one part at least. ends are their running lengths."""
    return max(i + 1, bisect_right(ends, (ends[i - 1] if i else 0) + room))


def pack_paragraphs(text: str, size: int = 500, overlap: int = 50) -> list[str]:
    """Paragraphs joined up to `size` characters (joints aside), each pack after the tail of the one before it; one that is
    longer than that is cut into windows, and no tail passes it."""
    out: list[str] = []
    for long, stretch in groupby(filter(None, map(str.strip, re.split(r"\n\n+", text))), lambda p: len(p) > size):
        parts = list(stretch)
        if long:
            out += [w for p in parts for w in _windows(p, size, overlap)]
            continue
        ends, tail, i = list(accumulate(map(len, parts))), "", 0
        while i < len(parts):
            j = _reach(ends, i, size - len(tail))
            out.append("\n\n".join(filter(None, [tail, *parts[i:j]])))
            tail, i = out[-1][-overlap:].strip() if overlap else "", j
    return out


def split_table(text: str, size: int = 500) -> list[str]:
    """Rows of a long table in pieces, each under the two header lines, which count for its size."""
    head, rows = text.split("\n")[:2], text.split("\n")[2:]
    ends, cuts = list(accumulate(map(len, rows))), [0]
    while cuts[-1] < len(rows):
        cuts.append(_reach(ends, cuts[-1], size - sum(map(len, head))))
    return ["\n".join(head + rows[i:j]) for i, j in zip(cuts, cuts[1:])] or [text]


def _pieces(kind: str, text: str, size: int, overlap: int) -> list[str]:
    if kind == "table":
        return [text] if len(text) <= 2 * size else split_table(text, size)
    return [text] if kind == "code" else pack_paragraphs(text, size, overlap)


def _columns(text: str) -> list[str]:
    head = text.strip().split("\n")[0]
    return [x for c in head.split("|") if (x := c.strip()) and x != "---"] if "|" in head else []


def _chunker(key: str, sent: pa.Schema, strategy: str, size: int, overlap: int, keep_heading_path: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of (k, t) to batches of chunks of about CHARS characters."""
    names = _names()

    def rows(k: int, t: str) -> Iterator[tuple]:
        """The document's place in its batch and CHUNK's columns of each of its chunks."""
        n = 0
        for s, (path, body) in enumerate(sections(t) if strategy == "structured" else [([], t)]):
            prefix = " > ".join(path) + "\n\n" if path and keep_heading_path else ""
            for b, (kind_, part) in enumerate(blocks(body)):
                for p, piece in enumerate(_pieces(kind_, part, size, overlap)):
                    yield k, s, b, p, n, kind_, " > ".join(path), len(path), _columns(part) if kind_ == "table" else None, prefix + piece
                    n += 1

    def packed(keys: pa.Array, held: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*held)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)).cast(sent.field(0).type), *[pa.array(c, f.type) for c, f in zip(columns, list(sent)[1:])]], names=[key, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, width = batch.column("k"), [], 0
            for i in range(batch.num_rows):  # a text at a time, and chunks go on once they hold CHARS characters
                for row in rows(i, batch.column("t")[i].as_py()):
                    held.append(row)
                    width += len(row[-1])
                    if width >= CHARS:
                        yield packed(keys, held)
                        held, width = [], 0
            if held:
                yield packed(keys, held)

    return run


def chunk(df: DataFrame, key: str = "source_file", text: str = "text", strategy: str = "structured", size: int = 500, overlap: int = 50, keep_heading_path: bool = True) -> DataFrame:
    """One row for each chunk: the key, CHUNK's columns and chunk_strategy; chunk_index counts from 0 within a document.

    structured cuts sections by headings first and puts their path before each chunk; recursive takes the text as one.
    """
    if strategy not in ("structured", "recursive"):
        raise ValueError(f"unknown strategy {strategy}")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {CHUNK}"
    src = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sent = pa.schema([pa.field(n, to_arrow_type(t)) for n, t in [(key, df.schema[key].dataType), *[(f.name, f.dataType) for f in StructType.fromDDL(CHUNK)]]])

    run = _chunker(key, sent, strategy, size, overlap, keep_heading_path)
    return src.mapInArrow(run, schema).withColumn("chunk_strategy", F.lit(strategy))


def split_sections(df: DataFrame, key: str = "source_file", text: str = "text") -> DataFrame:
    def run(frames):
        for f in frames:
            yield pd.DataFrame([(k, i, path, body) for k, t in zip(f["k"], f["t"]) for i, (path, body) in enumerate(sections(t))], columns=[key, "section", "heading_path", "body"])

    src = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return src.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, section int, heading_path array<string>, body string")


def build_corpus(docs: DataFrame, strategy: str = "structured", key: str = "source_file", text: str = "text", loader: tuple[str, ...] = (), **options) -> DataFrame:
    """The chunks of docs, cleaned and marked first: all columns of docs but text, the document's metadata, and CHUNK's columns.

    The document's columns go through the chunker as one key, so nothing is shuffled and rows that repeat a document give
    its chunks as often. Null text gives no chunk. Columns of docs named as one of CHUNK's or as metadata are replaced (the
    latter stay where loader names them). An empty table gives no rows.
    """
    own = _names()
    ready = docs.where(F.col(text).isNotNull()).select(*[c for c in docs.columns if c not in (text, *own)], clean_text(F.col(text)).alias(text))
    described = extract_metadata(mark_structures(ready, text), name=key, body=text, loader=loader)
    whole = F.struct(*[c for c in described.columns if c != text])
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    keyed = described.select(F.to_json(whole, {"ignoreNullFields": "false", **form}).alias("__document"), F.col(text).alias("text"))
    kind = described.select(whole.alias("d")).schema["d"].dataType
    chunks = chunk(keyed, "__document", "text", strategy, **options)
    return chunks.withColumn("__document", F.from_json("__document", kind, form)).select("__document.*", *own, "chunk_strategy")
