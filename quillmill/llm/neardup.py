"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_bytes, filter_size, in_filter, materialize, mix, repeated, split_by_keys, text_bytes, with_rows

SHINGLE = 5
IDF_BITS = 18
#: Members up to which an open bucket is compared in full.
SMALL = 24


def _gamma_table(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the midpoints of n equal parts, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
    return x.astype(np.float32)


_GAMMA = _gamma_table()
_LOG_GAMMA = np.log(_GAMMA)


def idf_table(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies of hashed words over all documents: 2**IDF_BITS numbers, whatever the corpus."""

    def count(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                w = Words(*text_bytes(part.column("text")))
                b = (w.hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)
                pairs = np.unique((w.row.astype(np.int64) << IDF_BITS) | b) & ((1 << IDF_BITS) - 1)
                word, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(word, -1)), pa.array(np.append(n, part.num_rows))], names=["word", "n"])

    found = docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = (np.asarray(found.column(c)).astype(np.int64) for c in ("word", "n"))
    total = int(n[word < 0].sum())
    df = np.zeros(1 << IDF_BITS)
    df[word[word >= 0]] = n[word >= 0]
    return (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)


class Shingles:
    """The distinct shingles of some texts with their weights: occurrences times the mean inverse document frequency of
    the words. A text of fewer words than SHINGLE has one shingle of all its words."""

    def __init__(self, column: pa.Array, idf: np.ndarray):
        w = Words(*text_bytes(column))
        h = w.hashes
        word_idf = idf[(h >> np.uint64(64 - IDF_BITS)).astype(np.int64)]
        sums = np.concatenate([np.zeros(1), np.cumsum(word_idf, dtype=np.float64)])
        rows, grams, weights = [], [], []
        for size in range(1, SHINGLE + 1):
            at, g = w.windows(h, size)
            if size < SHINGLE:
                short = w.n[w.row[at]] == size
                at, g = at[short], g[short]
            rows.append(w.row[at])
            grams.append(g)
            # Rounded, so that sums over other neighbours give the same weight.
            weights.append(np.round((sums[at + size] - sums[at]) / size, 3))
        row, gram, weight = np.concatenate(rows), np.concatenate(grams), np.concatenate(weights)
        order = np.lexsort((gram, row))
        row, gram, weight = row[order], gram[order], weight[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        at = np.flatnonzero(new)
        self.row, self.gram, self.many = row[at], gram[at], np.diff(np.append(at, len(row)))
        self.weight = weight[at] * self.many
        self.words = w

    def keep(self, rows: np.ndarray) -> None:
        """Forget the shingles of the other rows."""
        k = rows[self.row]
        self.row, self.gram, self.weight, self.many = self.row[k], self.gram[k], self.weight[k], self.many[k]

    def sample(self, unit: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of sampled occurrences. The i-th occurrence of a shingle in a text is an element of its own, so that
        weighted Jaccard is that of sets of elements; each is taken by hash with a chance in proportion to its weight, a
        sixteenth at the weight `unit`, and so alike in all texts."""
        each = np.repeat(np.arange(len(self.row)), self.many)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(self.many) - self.many, self.many)
        h = mix(self.gram[each] + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        k = np.flatnonzero((h & np.uint64(0xFFFF)) < 4096 / unit * (self.weight / self.many)[each])
        return self.row[each[k]], mix(h[k])

    def contents(self, n: int) -> list[bytes]:
        """A 128-bit digest of each text's word sequence."""
        w, h = self.words, self.words.hashes
        raw = h.tobytes()
        return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]


def signatures(s: Shingles, n: int, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """Band keys (texts by bands) of consistent weighted samples; texts without shingles have zeros.

    Each (shingle, hash) draws r and c from Gamma(2, 1) and b from [0, 1); t = floor(ln w / r + b), and the shingle of least
    ln c - r (t - b) - r is the sample, with its t. Two texts agree on a sample with their weighted Jaccard similarity.
    """
    out = np.zeros((n, bands), np.uint64)
    if not len(s.row):
        return out
    rng = np.random.default_rng(seed)
    mults = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.flatnonzero(np.concatenate([[True], s.row[1:] != s.row[:-1]]))
    who, lens = s.row[starts], np.diff(np.append(starts, len(s.row)))
    log_w = np.log(s.weight).astype(np.float32)
    part = np.repeat(np.arange(len(starts)), lens)
    for k in range(bands * rows):
        u = mix(s.gram * mults[k])
        r = _GAMMA[u >> np.uint64(48)]
        b = (u & np.uint64(0xFFFFFFFF)).astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(log_w / r + b)
        a = _LOG_GAMMA[(u >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (t - b + 1)
        hit = np.flatnonzero(a == np.minimum.reduceat(a, starts)[part])
        first = hit[np.concatenate([[True], part[hit[1:]] != part[hit[:-1]]])]
        sample = mix(s.gram[first] + t[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[who, k // rows] = mix(out[who, k // rows] * np.uint64(31) + sample + np.uint64(k + 1))
    return out


def unit_weight(idf: np.ndarray) -> float:
    """About the mean inverse document frequency of the words of all texts."""
    share = np.where(idf < idf.max(), np.exp(-idf.astype(np.float64)), 0.0)
    return float((idf * share).sum() / share.sum()) if share.any() else float(idf.max())


def may_match(s: Shingles, n: int, bits: np.ndarray, log_bits: int, unit: float) -> np.ndarray:
    """Which texts may have a near-duplicate: judged by their sampled occurrences of shingles.

    Of a text with a partner of weighted similarity 0.8, four fifths of the weight at least is met elsewhere, and samples fall
    in proportion to weight. With 12 samples, none met has a chance of 0.2**12 for it, with 24 samples, under two fifths one
    of 6 in a million. Shorter texts all pass.
    """
    row, h = s.sample(unit)
    size = np.bincount(row, minlength=n)
    met = np.bincount(row[in_filter(bits, h, log_bits)], minlength=n)
    return ~((size >= 12) & (met == 0) | (size >= 24) & (met < 0.4 * size))


def _verify(pairs: DataFrame, cast, least: float) -> DataFrame:
    """The pairs whose texts have a weighted Jaccard similarity of `least` or more."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text_a"):
                n, sides = part.num_rows, [Shingles(part.column(c), cast.value) for c in ("text_a", "text_b")]
                row, gram, weight = (np.concatenate([getattr(x, f) for x in sides]) for f in ("row", "gram", "weight"))
                order = np.lexsort((gram, row))
                row, gram, weight = row[order], gram[order], weight[order]
                both = np.flatnonzero((row[1:] == row[:-1]) & (gram[1:] == gram[:-1]))
                common = np.bincount(row[both], np.minimum(weight[both], weight[both + 1]), n).astype(np.float64)
                total = np.bincount(row, weight, n)
                sim = common / np.maximum(total - common, 1e-9)
                ok = np.flatnonzero(sim >= least - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column("a").take(pa.array(ok)), part.column("b").take(pa.array(ok)), pa.array(sim[ok])], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node with an edge; label is the least node of its component.

    Each round every node takes the least label around it, then its label's label; each round is written before the next.
    """
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("v").alias("node")).agg(F.least(F.min("u"), F.first("v")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = materialize(near.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("old != label").isEmpty():
            return labels


class NearDuplicates:
    """The classes of a corpus: rows (doc_id, content), mapping (content, class_id), winners (content, doc_id)."""

    def __init__(self, docs: DataFrame, least: float = 0.8, bands: int = 14, rows: int = 3, rounds: int = 2):
        spark = docs.sparkSession
        src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        cast = spark.sparkContext.broadcast(idf_table(src))  # 1 MB

        unit = unit_weight(cast.value)

        def samples(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            row, h = Shingles(part.column("text"), cast.value).sample(unit)
            return h, np.asarray(part.column("doc_id").to_numpy(zero_copy_only=False))[row]

        known = src.where("doc_id is not null")
        log_p, log_bits = filter_size(known)
        met = spark.sparkContext.broadcast(repeated(known, samples, log_p, log_bits))  # at most 16 MB

        def sign(column: pa.Array) -> list:
            s, n = Shingles(column, cast.value), len(column)
            ok = may_match(s, n, met.value, log_bits, unit) & (s.words.n > 0)
            total = np.bincount(s.row, s.weight, n).astype(np.float64)  # of no shingle at all, numpy counts in whole numbers
            digest = s.contents(n)
            s.keep(ok)
            keys = signatures(s, n, bands, rows)
            cut = np.concatenate([[0], np.cumsum(np.where(ok, bands, 0))]).astype(np.int32)
            return [pa.array(digest, pa.binary()), pa.array(total), pa.ListArray.from_arrays(pa.array(cut), pa.array(keys[ok].view(np.int64).ravel()))]

        signed = with_rows(src, sign, [("content", "binary"), ("weight", "double"), ("bands", "array<bigint>")]).drop("text")
        self.rows = materialize(signed, "signed")
        nodes = materialize(self.rows.groupBy("content").agg(F.min("doc_id").alias("doc"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "nodes")
        keys = nodes.where("doc is not null").select("content", "doc", "weight", F.explode("bands").alias("key"))
        shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        members = materialize(keys.join(shared, "key"), "members")
        self.links = self._link(spark, src, members, cast, least, rounds)
        mapped = nodes.select("content", "doc").join(self.links.withColumnRenamed("node", "content"), "content", "left").withColumn("label", F.coalesce("label", "content"))
        mapped = materialize(mapped, "mapped")
        first = materialize(mapped.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "content")).alias("w")).select("label", F.col("w.doc").alias("class_id"), F.col("w.content").alias("winner")), "classes")
        self.mapping = materialize(mapped.join(first, "label").select("content", "class_id"), "mapping")
        self.winners = first.select(F.col("winner").alias("content"), F.col("class_id").alias("doc_id"))

    def _link(self, spark, src: DataFrame, members: DataFrame, cast, least: float, rounds: int) -> DataFrame:
        """Verified links as components.

        Rounds of stars: the members of a bucket meet its leader, the one with most company over all its buckets, so that
        copies of one text need a link each and a text edited many times meets its edits. Each round has the next leader.
        Buckets that still hold several components are then compared in full if they are small; the members of larger ones, as
        texts with a long common passage make, are joined exactly by their rarest shingles.
        """
        degree = members.groupBy("content").agg(F.sum("n").alias("degree"))
        members = materialize(members.join(degree, "content").drop("n"), "ranked")
        active = materialize(members.select("doc").distinct().withColumnRenamed("doc", "doc_id"), "active")
        near, _ = split_by_keys(src, active, ["doc_id"])
        # Joins of texts are merges at every size, so that a small run moves what a large one does.
        texts = with_rows(near.hint("merge").join(active.hint("merge"), "doc_id"), lambda c: [pa.array(Shingles(c, cast.value).contents(len(c)), pa.binary())], [("content", "binary")]).drop("doc_id")
        texts = materialize(texts.join(members.select("content").distinct(), "content", "left_semi").dropDuplicates(["content"]), "texts")
        self._labels = spark.createDataFrame([], "node binary, label binary")
        self._tested = spark.createDataFrame([], "a binary, b binary")
        left, led = members, spark.createDataFrame([], "key bigint, content binary")
        for _ in range(rounds):
            left = self._open(left)
            pairs, leaders = self._stars(left, led)
            led = led.unionByName(leaders)
            self._test(pairs, texts, cast, least)
        left = self._open(left)
        self._test(self._all(left), texts, cast, least)
        large = self._open(left).where(F.col("size") > SMALL)
        self._test(self._rare(large, texts, cast, least), texts, cast, least)
        return self._labels

    def _open(self, members: DataFrame) -> DataFrame:
        """The buckets that hold several components: members with label and size."""
        named = members.drop("label", "size").join(self._labels.withColumnRenamed("node", "content"), "content", "left").withColumn("label", F.coalesce("label", "content"))
        named = materialize(named, "named")
        several = materialize(named.groupBy("key").agg((F.min("label") != F.max("label")).alias("open"), F.count("*").alias("size")).where("open").drop("open"), "open")
        return materialize(named.join(several, "key"), "open-members")

    @staticmethod
    def _paired(rows: DataFrame) -> DataFrame:
        """Pairs (x, y) of two components whose total weights allow the similarity, each once."""
        fits = F.least("weight", "other_weight") >= 0.8 * F.greatest("weight", "other_weight") - 1e-6
        return rows.where((F.col("label") != F.col("other_label")) & fits).select(F.least("content", "other").alias("a"), F.greatest("content", "other").alias("b"))

    def _stars(self, members: DataFrame, led: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each open bucket's members with its next leader."""
        lead = members.join(led, ["key", "content"], "left_anti").groupBy("key").agg(F.max(F.struct("degree", "content", "label", "weight")).alias("top"))
        lead = materialize(lead.select("key", F.col("top.content").alias("other"), F.col("top.label").alias("other_label"), F.col("top.weight").alias("other_weight")), "leaders")
        return self._paired(members.join(lead, "key")), lead.select("key", F.col("other").alias("content"))

    def _all(self, members: DataFrame) -> DataFrame:
        """All pairs of two components in the buckets of at most SMALL members."""
        few = members.where(F.col("size") <= SMALL)
        other = few.select("key", F.col("content").alias("other"), F.col("label").alias("other_label"), F.col("weight").alias("other_weight"))
        return self._paired(few.join(other, "key").where(F.col("content") < F.col("other")))

    def _rare(self, members: DataFrame, texts: DataFrame, cast, least: float) -> DataFrame:
        """Pairs of two components among all members that may be `least` alike; none that is gets lost.

        Shingles have one order, the rarest among these texts first. What two texts share lies, in each, from their first common
        shingle on. Weights being A <= B, they share least / (1 + least) * (A + B) or more, so at least 2 * least / (1 + least)
        of A and `least` of B: that shingle stands before the rest of the lighter text weighs less than the former, and before
        the rest of the heavier one weighs less than the latter. A passage of many texts stands last, so it makes no pairs.
        """
        spark = members.sparkSession
        who = members.select("content", "label").distinct()
        held = materialize(texts.join(who, "content").select("content", "label", "text"), "large")
        cells = lambda gram: (gram >> np.uint64(64 - IDF_BITS)).astype(np.int64)

        def count(batches):
            for batch in batches:
                for part in by_bytes(batch, "text"):
                    cell, n = np.unique(cells(Shingles(part.column("text"), cast.value).gram), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

        found = held.select("text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        common = np.zeros(1 << IDF_BITS, np.int64)
        common[np.asarray(found.column("cell"))] = np.asarray(found.column("n"))
        ranks = spark.sparkContext.broadcast(common)  # 2 MB
        light = 2 * least / (1 + least)

        def prefixes(batches):
            for batch in batches:
                for part in by_bytes(batch, "text"):
                    x = Shingles(part.column("text"), cast.value)
                    order = np.lexsort((x.gram, ranks.value[cells(x.gram)], x.row))
                    row, gram, weight = x.row[order], x.gram[order], x.weight[order]
                    total = np.bincount(row, weight, part.num_rows)
                    ends = np.cumsum(total)[row]
                    rest = ends - np.concatenate([[0.0], np.cumsum(weight)[:-1]])
                    k = np.flatnonzero(rest >= least * total[row] - 1e-3)
                    mine = pa.array(row[k])
                    out = [pa.array(gram[k].view(np.int64)), part.column("content").take(mine), part.column("label").take(mine), pa.array(total[row[k]]), pa.array(rest[k]), pa.array(rest[k] >= light * total[row[k]] - 1e-3)]
                    yield pa.RecordBatch.from_arrays(out, names=["gram", "content", "label", "weight", "rest", "light"])

        rows = materialize(held.mapInArrow(prefixes, "gram bigint, content binary, label binary, weight double, rest double, light boolean"), "prefixes")
        several = rows.groupBy("gram").agg((F.min("label") != F.max("label")).alias("open"), F.max("light").alias("led")).where("open and led").select("gram")
        rows = materialize(rows.join(several, "gram"), "open-prefixes")
        # Each gram's rows meet those that are not of its commonest label: every pair of two labels has such a side, and many
        # rows of one label make no pairs among themselves.
        by_label = rows.groupBy("gram", "label").agg(F.count("*").alias("n"))
        commonest = by_label.groupBy("gram").agg(F.max_by("label", F.struct("n", "label")).alias("commonest"))
        apart = materialize(rows.join(commonest, "gram").where("label != commonest").drop("commonest"), "outsiders")
        other = rows.select("gram", *[F.col(c).alias(f"other_{c}") for c in ("content", "label", "weight", "rest", "light")])
        need = least / (1 + least) * (F.col("weight") + F.col("other_weight")) - 1e-2
        close = (F.least("weight", "other_weight") >= least * F.greatest("weight", "other_weight") - 1e-2) & (F.least("rest", "other_rest") >= need)
        led = F.col("light") & (F.col("weight") <= F.col("other_weight") + 1e-2) | F.col("other_light") & (F.col("other_weight") <= F.col("weight") + 1e-2)
        pairs = apart.join(other, "gram").where((F.col("label") != F.col("other_label")) & close & led)
        return pairs.select(F.least("content", "other_content").alias("a"), F.greatest("content", "other_content").alias("b"))

    def _test(self, pairs: DataFrame, texts: DataFrame, cast, least: float) -> None:
        """Verify the pairs that are new, and let their links join components."""
        new = materialize(pairs.distinct().join(self._tested, ["a", "b"], "left_anti"), "pairs")
        self._tested = self._tested.unionByName(new)
        full = new.hint("merge").join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").hint("merge").join(texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        found = materialize(_verify(full, cast, least), "links")
        if not found.isEmpty():
            old = self._labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
            self._labels = components(found.select("a", "b").unionByName(old))


def classes(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, class_id (the least doc_id of its class), kept (it is that document).

    A class is a connected component of links between texts of weighted Jaccard similarity `least` or more on five-word
    shingles (words lower-cased, punctuation aside); texts of equal word sequences are of one class, so are all without
    words (null and empty ones too). Fewer than five words make one shingle. Rows that repeat a doc_id get a row each. A row
    with null doc_id belongs to the class of its copies, or to none. Empty tables give no rows; extra columns are ignored.
    """
    d = NearDuplicates(docs, **options)
    return d.rows.join(d.mapping, "content").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: that of the least doc_id (of rows alike in doc_id and words, one). All columns
    pass through. A class whose rows all have null doc_id keeps one of them."""
    d = NearDuplicates(docs, **options)
    own = docs.withColumn("__qm_words", F.coalesce(F.col("text").cast("string"), F.lit("")))
    none = np.zeros(1 << IDF_BITS, np.float32)
    keyed = with_rows(own, lambda c: [pa.array(Shingles(c, none).contents(len(c)), pa.binary())], [("__qm_content", "binary")], text="__qm_words").drop("__qm_words")
    won = d.winners.select(F.col("content").alias("__qm_content"), F.col("doc_id").alias("__qm_id"))
    kept = keyed.join(won, (keyed["__qm_content"] == won["__qm_content"]) & keyed["doc_id"].eqNullSafe(won["__qm_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__qm_content"]).drop("__qm_content")
