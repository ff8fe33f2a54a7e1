"""Near-duplicate vectors: binary codes under a random rotation, with stored correction factors. Unbiased estimates of inner
products and their confidence bounds decide which pairs are computed exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_size, in_filter, materialize, mix, repeated, split_by_keys
from .neardup import components

#: Standard deviations that an estimate may fall short of the threshold by: a true pair falls further with 3 chances in 100,000.
SIGMAS = 4.0
#: Chance that a pair right at the threshold shares no key.
MISS = 1e-4
#: Members of a bucket that meet in one task; larger buckets are divided into blocks of about half as many.
BLOCK = 512
#: Members up to which the groups of a batch are compared together, place by place.
FEW = 48


@lru_cache(8)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(4)
def _planes(dim: int, n: int) -> np.ndarray:
    return np.hstack([rotation(dim, 1000 + i) for i in range(-(-n // dim))])[:, :n]


def key_shape(most: int, near: float) -> tuple[int, int]:
    """(bits, tables): keys of so many sign bits that unlike vectors of the largest label seldom share one, and so many of
    them that a pair at the threshold shares one but for a chance of MISS."""
    same = 1 - math.acos(near) / math.pi
    bits = min(60, max(6, math.ceil(math.log2(max(most, 2))) + 2))
    return bits, math.ceil(math.log(MISS) / math.log(1 - same**bits))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the usable vectors: not null, not empty, not zero, all components finite."""
    lens = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    at = np.cumsum(lens) - lens
    for n in np.unique(lens[lens > 0]).tolist():
        rows = np.flatnonzero(lens == n)
        m = flat[at[rows][:, None] + np.arange(n)] + 0.0
        ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        if ok.any():
            yield rows[ok], m[ok]


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def keys(x: np.ndarray, salt: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Keys (vectors by tables): each mixes `bits` signs of projections with the table and the label's salt."""
    signs = x @ _planes(x.shape[1], bits * tables) > 0
    packed = signs.reshape(len(x), tables, bits) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    return mix(mix(packed + salt[:, None]) + np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _salts(labels: list, dim: int) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b(f"{dim}:{x}".encode(), digest_size=8).digest(), "little") for x in set(labels)}
    return np.array([known[x] for x in labels], np.uint64)


def encode(x: np.ndarray) -> list[bytes]:
    """A vector's code: the signs of its rotated coordinates, the factor that makes estimates unbiased, and the coordinates
    themselves in 4 bits, dithered so that they are right on average, with their step and least value."""
    n, d = x.shape
    y = x @ rotation(d, 1)
    factor = np.abs(y).sum(axis=1) / math.sqrt(d)
    low = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - low) / 14, 1e-12)
    q = np.floor((y - low[:, None]) / step[:, None] + np.random.default_rng([7, d]).random(d)).astype(np.uint8)
    q = np.pad(q, ((0, 0), (0, d % 2)))
    parts = [np.packbits(y > 0, axis=1), q[:, ::2] | (q[:, 1::2] << 4), np.stack([factor, step, low], axis=1).astype("<f4").view(np.uint8)]
    return [r.tobytes() for r in np.hstack([p.reshape(n, -1) for p in parts])]


def decode(codes: list[bytes], d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs by their factor, rotated coordinates, standard deviation of an estimate at the threshold's sine of 1)."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    a, b = -(-d // 8), -(-d // 8) + -(-d // 2)
    signs = np.unpackbits(raw[:, :a], axis=1)[:, :d].astype(np.float32) * 2 - 1
    q = np.stack([raw[:, a:b] & 15, raw[:, a:b] >> 4], axis=2).reshape(len(raw), -1)[:, :d]
    factor, step, low = np.ascontiguousarray(raw[:, b:]).view("<f4").T
    return signs / (math.sqrt(d) * factor[:, None]), q * step[:, None] + low[:, None], np.stack([(1 - factor**2) / factor**2 / max(d - 1, 1), (step / 2 / factor) ** 2])


def _bound(noise: np.ndarray, near: float) -> np.ndarray:
    """How far below the threshold an estimate of a true pair may lie, for each vector as the coded side."""
    return SIGMAS * np.sqrt((1 - near * near) * noise[0] + noise[1])


def whole_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in runs of equal keys as tables that end with a run, and the starts of the runs."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        columns = [np.asarray(t.column(c)) for c in by]
        new = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1])
        if new[-1]:
            yield t.slice(0, new[-1]), new[:-1]
        held = t.slice(new[-1])
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _dealt(members: DataFrame, columns: list[str]) -> DataFrame:
    """members in groups (bucket, i, j): a bucket whole, or two blocks of a large one; side tells a row's block in it.

    In a group (i, j) of two blocks only pairs of one from each count, in (i, i) all: so each pair of a bucket meets once.
    """
    large = materialize(members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large-buckets")
    some, rest = split_by_keys(members, large, ["bucket"])
    some = some.join(large, "bucket", "left").withColumn("blocks", F.greatest(F.ceil(F.coalesce("n", F.lit(1)) / (BLOCK // 2)), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    some = some.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    some = some.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), *columns)
    rest = rest.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("side"), *columns)
    return some.unionByName(rest).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _counts(i: np.ndarray, j: np.ndarray, side: np.ndarray, x, y) -> np.ndarray:
    """Whether rows x and y of one group are a pair that counts there."""
    return (i[x] == j[x]) | (side[x] != side[y])


def candidates(members: DataFrame, near: float) -> DataFrame:
    """(bucket, place, node) of the members whose code doesn't rule out a partner in their bucket."""

    def run(batches):
        for t, starts in whole_groups(batches, ("bucket", "i", "j")):
            i, j, side, dims = (np.asarray(t.column(c)) for c in ("i", "j", "side", "dim"))
            size = np.diff(np.append(starts, t.num_rows))
            group = np.repeat(np.arange(len(starts)), size)
            met = np.zeros(t.num_rows, bool)
            codes = t.column("code").to_pylist()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)  # whole groups: a bucket's vectors have one length
                signs, coordinates, noise = decode([codes[k] for k in at.tolist()], d)
                slack = _bound(noise, near)
                g, n = group[at], size[group[at]]
                few = n <= FEW
                for off in range(1, int(n[few].max(initial=1))):
                    x = np.flatnonzero((g[:-off] == g[off:]) & few[:-off])
                    if not len(x):
                        continue
                    y = x + off
                    estimate = (np.einsum("ij,ij->i", signs[x], coordinates[y]) + np.einsum("ij,ij->i", signs[y], coordinates[x])) / 2
                    k = (estimate >= near - (slack[x] + slack[y]) / 2) & _counts(i, j, side, at[x], at[y])
                    met[at[x[k]]] = met[at[y[k]]] = True
                for one in np.unique(g[~few]).tolist():
                    r = np.flatnonzero(g == one)
                    e = signs[r] @ coordinates[r].T
                    ok = (e + e.T) / 2 >= near - (slack[r][:, None] + slack[r]) / 2
                    ok &= _counts(i, j, side, at[r][:, None], at[r][None, :])
                    np.fill_diagonal(ok, False)
                    met[at[r[ok.any(axis=1)]]] = True
            hit = pa.array(np.flatnonzero(met))
            yield from t.select(["bucket", "place", "node"]).take(hit).combine_chunks().to_batches()

    return _dealt(members, ["place", "node", "dim", "code"]).mapInArrow(run, "bucket bigint, place int, node binary").distinct()


def _roots(link: np.ndarray) -> np.ndarray:
    """The least number reachable from each row of a symmetric matrix of links."""
    root = np.arange(len(link))
    while True:
        least = np.minimum(root, np.where(link, root[None, :], len(link)).min(axis=1, initial=len(link)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def exact(members: DataFrame, near: float, bits: int, tables: int) -> DataFrame:
    """(node, root, links): how many vectors each node links with in a group, and a node of its component there.

    A pair counts in the bucket of its first common key only, so that no link is counted twice; no pair becomes a row.
    """

    def run(batches):
        for t, starts in whole_groups(batches, ("bucket", "i", "j")):
            out: list[tuple] = []
            nodes, labels = t.column("node").to_pylist(), t.column("label").to_pylist()
            i, j, side, place, copies = (np.asarray(t.column(c)) for c in ("i", "j", "side", "place", "copies"))
            ends = np.append(starts[1:], t.num_rows)
            column = t.column("vector").combine_chunks()
            for a, z in zip(starts.tolist(), ends.tolist()):
                for rows, m in by_length(column.slice(a, z - a)):
                    x, r = unit(m), a + rows
                    link = x @ x.T >= near
                    link &= _counts(i, j, side, r[:, None], r[None, :])
                    np.fill_diagonal(link, False)
                    if not link.any():
                        continue
                    salts = _salts([labels[k] for k in r.tolist()], x.shape[1])
                    link &= salts[:, None] == salts[None, :]
                    own = keys(x, salts, bits, tables)
                    for c in range(int(place[a])):
                        link &= own[:, c][:, None] != own[:, c][None, :]
                    links, root = link @ copies[r], _roots(link)
                    out += [(nodes[r[k]], nodes[r[root[k]]], int(links[k])) for k in np.flatnonzero(links).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64()))], names=["node", "root", "links"])

    return _dealt(members, ["place", "node", "label", "copies", "vector"]).mapInArrow(run, "node binary, root binary, links bigint")


def near_vectors(table: DataFrame, near: float = 0.98, vector: str = "embedding") -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id (the least vec_id that links reach), kept (it is that one).

    Two vectors link if their labels are equal and not null and their cosine, in double precision, is `near` or more. Vectors
    that are null, empty or zero, or hold a null or not finite component, and those of other lengths link with nothing. Copies
    are one node with their count, so n copies need no pairs. Rows that repeat a vec_id are vectors of their own. A row with
    null vec_id links with nothing, has no component and isn't kept. An empty table gives no rows; other columns are ignored.

    Vectors meet by keys of sign bits under random rotations; a pair at the threshold shares none with a chance of MISS.
    """
    spark = table.sparkSession
    src = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))

    def name(batches):
        for b in batches:
            labels, node, dims = b.column("label").to_pylist(), [None] * b.num_rows, [0] * b.num_rows
            known = np.asarray(b.column("vec_id").is_valid()) & np.asarray(b.column("label").is_valid())
            for rows, m in by_length(b.column("vector")):
                for r, v in zip(rows.tolist(), m):
                    if known[r]:
                        node[r], dims[r] = hashlib.blake2b(f"{labels[r]}\0".encode() + v.tobytes(), digest_size=16).digest(), len(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node, pa.binary()), pa.array(dims, pa.int32())], names=[*b.schema.names, "node", "dim"])

    named = src.mapInArrow(name, "vec_id bigint, label string, vector array<double>, node binary, dim int")
    rows = materialize(named.select("vec_id", "node"), "vector-rows")
    folded = named.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    nodes = materialize(folded, "vectors")
    most = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = key_shape(most, near)

    def keyed(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        labels = part.column("label").to_pylist()
        for r, m in by_length(part.column("vector")):
            x = unit(m)
            yield r, x, keys(x, _salts([labels[k] for k in r.tolist()], x.shape[1]), bits, tables)

    def owners(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        number = np.frombuffer(b"".join(part.column("node").to_pylist()), "<i8")[::2]
        found = [(k.ravel(), np.repeat(number[r], tables)) for r, _, k in keyed(part)] or [(np.zeros(0, np.uint64), number[:0])]
        return np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])

    log_p, log_bits = filter_size(nodes)
    shared = spark.sparkContext.broadcast(repeated(nodes, owners, log_p, log_bits, None))  # at most 16 MB

    def emit(batches):
        for b in batches:
            held = b.column("node")
            for r, x, k in keyed(b):
                row, place = np.nonzero(in_filter(shared.value, k.ravel(), log_bits).reshape(k.shape))
                codes = pa.array(encode(x), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(k[row, place].view(np.int64)), pa.array(place.astype(np.int32)), held.take(pa.array(r[row])), pa.array(np.full(len(row), x.shape[1], np.int32)), codes.take(pa.array(row))], names=["bucket", "place", "node", "dim", "code"])

    members = nodes.select("node", "label", "vector").mapInArrow(emit, "bucket bigint, place int, node binary, dim int, code binary")
    close = materialize(candidates(materialize(members, "keyed"), near), "close")
    found = materialize(exact(close.join(nodes.select("node", "label", "copies", "vector"), "node"), near, bits, tables), "links")
    edges = found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    named_as = components(edges)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies", "first_id").join(links, "node", "left").join(named_as, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = materialize(known, "known")
    least = known.groupBy("label").agg(F.min("first_id").alias("component"))
    known = known.join(least, "label").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component")
    out = rows.join(known, "node", "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
