"""Benchmark decontamination: training token windows against a broadcast hash set of normalised benchmark n-grams."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, appended, by_bytes, materialize, text_bytes, with_rows

FIELDS = [("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean"), ("clean_text", "string"), ("hits", "array<struct<first:int,size:int,item:string>>")]
_HIT = pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32()), ("item", pa.string())]))


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """One row for each (window text, item): `size` consecutive words, or all words of a shorter item."""

    def grams(column: pa.Array) -> list:
        w = Words(*text_bytes(column))
        out = []
        for a, n in zip(w.first[:-1], w.n):
            k = min(size, int(n))
            out.append(sorted({(k, w.text(int(i), k)) for i in range(int(a), int(a + n - k + 1))} if k else set()))
        return [pa.array([[{"size": k, "gram": g.decode("utf-8", "surrogateescape")} for k, g in x] for x in out], pa.list_(pa.struct([("size", pa.int32()), ("gram", pa.string())])))]

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null")
    found = with_rows(items, grams, [("grams", "array<struct<size:int,gram:string>>")])
    return found.select("item", F.explode("grams").alias("g")).select("item", "g.size", "g.gram").distinct()


class _Grams:
    """A block of benchmark windows as the scan needs it: hashes by window size behind a bit filter."""

    def __init__(self, rows: list[tuple[str, int, str]]):
        self.items: dict[bytes, list[str]] = {}
        sizes: dict[int, set[bytes]] = {}
        for item, size, gram in rows:
            g = gram.encode("utf-8", "surrogateescape")
            self.items.setdefault(g, []).append(item)
            sizes.setdefault(size, set()).add(g)
        self.by_size = []
        for size, grams in sorted(sizes.items()):
            texts = sorted(grams)
            w = Words(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.array([0, sum(map(len, texts)) + len(texts)]))
            h = w.hashes
            _, all_h = w.windows(h, size)
            known = np.unique(all_h[::size] if size > 1 else all_h)
            seen = np.zeros(1 << 20, bool)
            seen[known >> np.uint64(44)] = True
            self.by_size.append((size, known, seen))

    def scan(self, w: Words) -> list[tuple[int, int, bytes]]:
        """(first word, words, window) of each verified occurrence."""
        found, h = [], w.hashes
        for size, known, seen in self.by_size:
            at, g = w.windows(h, size)
            near = np.flatnonzero(seen[g >> np.uint64(44)])
            place = np.minimum(np.searchsorted(known, g[near]), len(known) - 1)
            for i in at[near[known[place] == g[near]]].tolist():
                if (t := w.text(i, size)) in self.items:
                    found.append((i, size, t))
        return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, block_rows: int = 400_000) -> DataFrame:
    """docs with the words, hit words and benchmark items found in each text.

    A window is `size` consecutive words of an item, or all its words if it has fewer. n_hit counts a text's words
    inside any occurrence; contaminated: n_hit > 0 and share * n_hit >= n_words. clean_text is the text without the
    hit words, hits lists the occurrences. The windows are broadcast in blocks of at most block_rows (about
    60 MB of words); a larger benchmark takes more passes, each written before the next.

    Null text: no words (clean_text stays null-safe as ''). Rows of the benchmark with null item_id or text without
    words have no windows. Repeated documents are judged one by one; repeated items count once. Empty tables give no
    rows. Extra columns pass through, but for those named as an output, which are replaced.
    """
    spark = docs.sparkSession
    grams = benchmark_windows(benchmark, size)
    n = grams.count()
    blocks = max(1, -(-n // block_rows))
    grams = grams.withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(blocks)))
    if blocks > 1:
        grams = materialize(grams, "grams")
    prior = "__qm_hits"
    cur = docs.withColumn(prior, F.lit(None).cast(FIELDS[-1][1]))
    for b in range(blocks):
        cast = spark.sparkContext.broadcast(_Grams([tuple(r) for r in grams.where(F.col("block") == b).select("item", "size", "gram").collect()]))
        cur = _pass(cur, cast, share, prior)
        if b + 1 < blocks:
            cur = materialize(cur.withColumn(prior, F.col("hits")), "hits")
    return cur.drop(prior)


def _pass(docs: DataFrame, cast, share: int, prior: str) -> DataFrame:
    packed = docs.withColumn("__qm_prior", F.coalesce(F.to_json(prior), F.lit("[]")))

    def scan(column: pa.Array) -> list:
        data, offsets = text_bytes(column)
        w = Words(data, offsets)
        hits: list[dict] = [{} for _ in range(len(column))]
        for i, k, t in cast.value.scan(w):
            r = int(w.row[i])
            for item in cast.value.items[t]:
                hits[r][(i - int(w.first[r]), k, item)] = None
        return [w, hits, data, offsets]

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "__qm_text"):
                w, hits, data, offsets = scan(part.column("__qm_text"))
                n_hit, items, sha, clean = [], [], [], []
                olds = part.column("__qm_prior")
                for r in range(part.num_rows):
                    if len(old := olds[r].as_py()) > 2:
                        hits[r] |= {(x["first"], x["size"], x["item"]): None for x in json.loads(old)}
                    own = data[offsets[r] : offsets[r + 1]]
                    names = sorted({x[2] for x in hits[r]})
                    hit = np.zeros(int(w.n[r]), bool)
                    for first, k, _ in hits[r]:
                        hit[first : first + k] = True
                    n_hit.append(int(hit.sum()))
                    items.append(len(names))
                    sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                    if n_hit[-1]:
                        keep = np.ones(len(own), bool)
                        for j in np.flatnonzero(hit):
                            keep[w.starts[w.first[r] + j] - offsets[r] : w.ends[w.first[r] + j] - offsets[r]] = False
                        own = own[keep]
                    clean.append(own.tobytes().decode("utf-8", "replace"))
                n_words = w.n.astype(np.int64)
                bad = [h > 0 and share * h >= t for h, t in zip(n_hit, n_words.tolist())]
                new = [pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array(items, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_()), pa.array(clean, pa.string()), pa.array([[{"first": a, "size": k, "item": x} for a, k, x in sorted(h)] for h in hits], _HIT)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in out] + new, names=out + [f for f, _ in FIELDS])

    names = {f for f, _ in FIELDS} | {"__qm_prior"}
    out = [c for c in packed.columns if c.lower() not in names]
    src = packed.select(*[F.col(f"`{c}`") for c in out], "__qm_prior", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__qm_text"))
    return src.mapInArrow(run, appended(packed.select(*[F.col(f"`{c}`") for c in out]), FIELDS))
