"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_bytes, held_out, labelled, materialize, mix, table, text_bytes, with_rows

# Insults of common use, each a voter.
INSULTS = [
    "idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "fool",
    "jerk", "imbecile", "garbage", "vermin", "filth", "coward", "liar", "freak", "ugly", "hate", "shut", "kill", "die",
]
#: Lengths in bytes of the word beginnings that may become lexicon entries.
PREFIXES = (4, 5, 6, 7, 8)
#: Pattern voters, after the lexicon voters.
PATTERNS = 3


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and each word beginning."""
    rows, hashes = [w.row], [w.hashes]
    for size in PREFIXES:
        which, h = w.prefix_hashes(size)
        rows.append(w.row[which])
        hashes.append(h)
    return np.concatenate(rows), np.concatenate(hashes)


def patterns(data: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
    """Votes of the pattern voters per text: shouting, runs of exclamation marks, a word repeated at once."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    upper = np.bincount(row[(data >= 0x41) & (data <= 0x5A)], minlength=n)
    lower = np.bincount(row[(data >= 0x61) & (data <= 0x7A)], minlength=n)
    marks = np.zeros(n, np.int64)
    if len(data) > 1:
        marks = np.bincount(row[1:][(data[1:] == 0x21) & (data[:-1] == 0x21) & (row[1:] == row[:-1])], minlength=n)
    h = w.hashes
    twice = np.bincount(w.row[1:][(h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    return np.column_stack([upper > lower, marks >= 3, twice >= 2 + 0.02 * w.n]).astype(np.float32)


class Lexicon:
    """Entries as sorted hashes behind a bit filter; presence() gives a text-by-entry 0/1 matrix."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    def presence(self, w: Words, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.hashes)), np.float32)
        if len(self.hashes) and len(w.starts):
            row, h = features(w)
            near = np.flatnonzero(self.seen[h >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
            ok = self.hashes[at] == h[near]
            out[row[near][ok], at[ok]] = 1
        return out


def _word_hash(word: str) -> int:
    b = word.encode()
    return int(Words(np.frombuffer(b, np.uint8), np.array([0, len(b)])).hashes[0])


def mine(texts: DataFrame, entries: int, least: int) -> list[tuple[int, int, int]]:
    """(hash, toxic texts, clean texts) of the words and word beginnings that speak most for toxicity among labelled texts.

    Counting is a Spark aggregate over distinct (text, feature); only `entries` rows come to the driver."""

    def count(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                w = Words(*text_bytes(part.column("text")))
                y = np.array(part.column("y").to_pylist())
                row, h = features(w)
                order = np.lexsort((row, h))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                row, h = row[new], h[new]
                starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                if len(starts):
                    yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(np.add.reduceat((y[row] > 0.5).astype(np.int64), starts)), pa.array(np.add.reduceat((y[row] <= 0.5).astype(np.int64), starts))], names=["h", "toxic", "clean"])

    found = texts.select("y", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(count, "h bigint, toxic bigint, clean bigint")
    found = found.groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= least)
    best = F.col("toxic") / (F.col("toxic") + 4.0 * F.col("clean") + 1.0)
    return [tuple(r) for r in found.where(best > 0.75).orderBy(best.desc(), F.col("toxic").desc(), "h").limit(entries).collect()]


@dataclass
class LabelModel:
    """Class-conditional vote rates, discounted for correlated voters."""

    prior: float
    on: np.ndarray
    off: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + votes @ self.on + (1 - votes) @ self.off
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(n: float, counts: np.ndarray, votes: np.ndarray, y: np.ndarray) -> LabelModel:
    """Fit the generative model: counts are the co-votes of all n documents, votes and y the labelled ones.

    Pairs of voters that agree beyond what the labels explain are correlated. Accuracies: for each voter, the covariances
    with pairs of voters uncorrelated with it give its covariance with the hidden label (a triplet of conditionally
    independent voters determines it); this is averaged with the labelled rate. A voter's weight is divided by one plus
    its correlations, so that many forms of one word count about once.
    """
    prior = float(np.clip(y.mean(), 0.005, 0.9))
    toxic, clean = (y > 0.5).sum(), (y <= 0.5).sum()
    common = 2 * (votes.sum(0) + 0.02) / (len(y) + 2)  # two pseudo-texts of the common rate: an unseen voter says nothing
    r1 = (votes[y > 0.5].sum(0) + common) / (toxic + 2)
    r0 = (votes[y <= 0.5].sum(0) + common) / (clean + 2)
    rate = np.diag(counts) / max(n, 1)
    both = counts / max(n, 1)
    explained = prior * np.outer(r1, r1) + (1 - prior) * np.outer(r0, r0)
    sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    rho = np.clip((both - explained) / np.outer(sd, sd), 0, 1)
    rho[rho < 0.5] = 0  # what is left below comes of languages and topics; from there on two voters read the same words
    np.fill_diagonal(rho, 0)
    cov = both - np.outer(rate, rate)
    free = rho == 0
    spread = np.sqrt(prior * (1 - prior))
    gap = r1 - r0
    for i in range(len(rate)):
        js = np.flatnonzero(free[i] & (np.arange(len(rate)) != i))
        a, b = np.meshgrid(js, js)
        use = (a < b) & free[a, b] & (cov[a, b] > 1e-6)
        if use.sum() >= 3:
            squares = cov[i, a[use]] * cov[i, b[use]] / cov[a[use], b[use]]
            triplet = np.sqrt(max(float(np.median(squares)), 0)) / spread
            gap[i] = 0.5 * gap[i] + 0.5 * np.sign(gap[i]) * min(triplet, 1)
    p1 = np.clip(0.5 * r1 + 0.5 * (rate + (1 - prior) * gap), 1e-6, 0.999)
    p0 = np.clip(r0, 1e-6, 0.999)
    weight = 1 / (1 + rho.sum(1))
    # Voters speak for toxicity or abstain: one that turns out to speak against it is silent.
    return LabelModel(prior, weight * np.maximum(np.log(p1 / p0), 0), weight * np.minimum(np.log((1 - p1) / (1 - p0)), 0))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def votes(self, data: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
        return np.hstack([self.lexicon.presence(w, len(offsets) - 1), patterns(data, offsets, w)])

    def inputs(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        return self.votes(data, offsets, Words(data, offsets))

    def scores(self, column: pa.Array) -> np.ndarray:
        z = self.inputs(column) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))).astype(np.float64)


def _logistic(x: np.ndarray, target: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear weights on soft targets by Adam over the whole (bounded) sample."""
    w, b = np.zeros(x.shape[1] + 1), 0.0
    z = np.hstack([x, np.ones((len(x), 1), np.float32)])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - target) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    b = float(w[-1])
    return w[:-1], b


#: Parts of the table of co-votes that are summed apart, and the shards of tasks that are summed first.
PARTS, SHARDS = 16, 256


def agreement(docs: DataFrame, cast, width: int, unlabelled: int) -> tuple[int, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(texts, co-votes of each two voters, votes of at most `unlabelled` texts by slot) over all of docs.

    A task adds up the co-votes of its texts and sends the cells that are not 0, packed in PARTS rows; they are summed by shards of
    tasks and then as a whole, so a group has some hundred rows at most. A text's hash deals it to a slot, and the text of least
    hash there stays; equal texts count once. What comes to the driver follows the voters and slots.
    """
    up, right = np.triu_indices(width)
    cells = -(-len(up) // PARTS)

    def run(batches):
        total, n = np.zeros((width, width)), 0
        slots: dict[int, tuple[int, bytes]] = {}
        for batch in batches:
            for part in by_bytes(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                w = Words(data, offsets)
                v = cast.value.votes(data, offsets, w)
                total += v.T @ v
                n += len(v)
                place = (np.arange(len(w.row)) - w.first[:-1][w.row] + 1).astype(np.uint64)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * place)])
                key = mix(np.diff(sums[w.first]) + w.n.astype(np.uint64)).view(np.int64)
                packed = np.packbits(v.astype(bool), axis=1)
                for i, (k, slot) in enumerate(zip(key.tolist(), (key % unlabelled).tolist())):
                    if slot not in slots or k < slots[slot][0]:
                        slots[slot] = (k, packed[i].tobytes())
        line = total[up, right].astype(np.int64)
        some = np.flatnonzero(line)
        shard = TaskContext.get().partitionId() % SHARDS
        rows = [("n", 0, shard, n, None)]
        for p in np.unique(some // cells).tolist():
            at = some[some // cells == p]
            rows.append(("cells", p, shard, 0, np.concatenate([at, line[at]]).tobytes()))
        rows += [("slot", slot, shard, k, votes) for slot, (k, votes) in slots.items()]
        for lo in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_pylist([dict(zip(found.names, r)) for r in rows[lo : lo + 1024]], schema=found)

    found = pa.schema([("kind", pa.string()), ("at", pa.int64()), ("shard", pa.int32()), ("n", pa.int64()), ("packed", pa.binary())])

    def added(key, table):
        pairs = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("packed").to_pylist()]
        line = np.zeros(cells, np.int64)
        first = key[0].as_py() * cells
        for at, number in pairs:
            line[at - first] += number
        at = np.flatnonzero(line)
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([np.concatenate([at + first, line[at]]).tobytes()], pa.binary())})

    src = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    votes = materialize(src.mapInArrow(run, "kind string, at bigint, shard int, n bigint, packed binary"), "votes")
    packed = votes.where("kind = 'cells'")
    for by in (["at", "shard"], ["at"]):
        packed = packed.groupBy(*by).applyInArrow(added, "at bigint, packed binary")
    counts = np.zeros((width, width))
    for r in packed.toLocalIterator():  # PARTS rows
        at, number = np.frombuffer(r["packed"], np.int64).reshape(2, -1)
        counts[up[at], right[at]] = counts[right[at], up[at]] = number
    n = votes.where("kind = 'n'").agg(F.sum("n")).first()[0] or 0
    least = votes.where("kind = 'slot'").groupBy("at").agg(F.min(F.struct("n", "packed"))["packed"].alias("packed"))
    bits = lambda x: np.unpackbits(np.frombuffer(x, np.uint8), count=width)
    return n, counts, sorted(((r["at"], bits(r["packed"])) for r in least.toLocalIterator()), key=lambda m: m[0])


def fit(spark: SparkSession, sf_dir: str, docs: DataFrame, most: int = 12_000, entries: int = 400, least: int = 5, unlabelled: int = 16_384) -> Model:
    """Lexicon and rates from at most `most` labelled documents, co-votes from all of docs; the linear classifier learns the label
    model's posteriors of those documents and of at most `unlabelled` others. Without labelled rows the fixed insults alone
    make the lexicon, and each is trusted alike.
    """
    rows = F.broadcast(labelled(spark, sf_dir, "toxic", most))  # at most `most` rows
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(rows, "doc_id").select("y", "text")
    mined = mine(texts, entries, least)
    fixed = np.array([_word_hash(x) for x in INSULTS], np.uint64)
    lexicon = Lexicon(np.concatenate([np.array([m[0] for m in mined], np.int64).view(np.uint64), fixed]))
    model = Model(lexicon, np.zeros(len(lexicon.hashes) + PATTERNS), 0.0)
    cast = spark.sparkContext.broadcast(model)  # a few hundred entries

    n, counts, more = agreement(docs, cast, len(model.weights), unlabelled)
    got = with_rows(texts, lambda c: [pa.array([x.tobytes() for x in cast.value.inputs(c).astype(np.uint8)], pa.binary())], [("x", "binary")]).select("y", "x").collect()
    if not got:
        model.weights[: len(lexicon.hashes)] = 3.0
        model.bias = -2.0
        return model
    got.sort(key=lambda r: (bytes(r[1]), r[0]))
    y, x = np.array([r[0] for r in got]), np.array([np.frombuffer(r[1], np.uint8) for r in got]).astype(np.float32)
    generative = label_model(n, counts, x, y)
    if more:
        x = np.vstack([x, np.array([v for _, v in more], np.float32)])
    model.weights, model.bias = _logistic(x, generative.posterior(x))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from threshold on).

    Null and empty texts have no votes and score by the bias alone. Rows are judged one by one, repeated ones alike; extra
    columns pass through, those named as an output are replaced; an empty table gives no rows.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def fn(column: pa.Array) -> list:
        s = np.round(cast.value.scores(column), 9)  # sums over other neighbours differ in their last digits
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return with_rows(docs, fn, [("score", "double"), ("predicted", "int")])


def classify(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    return score(docs, fit(spark, sf_dir, docs)).withColumn("held_out", held_out(F.col("doc_id")))
