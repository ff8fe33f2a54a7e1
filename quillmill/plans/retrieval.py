"""Search, fusion, reranking and their evaluation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import TERMS
from ..functions.text import token_pattern, words
from ..operators import dense, evaluate, fuse, names, passages, pivots, postings, rerank
from ..operators.stores import VariantStore
from ..sources.shared import materialize, new_path
from .registry import query, table, view

# Views.
CHUNKS = "SELECT doc_id, text, source AS source_file, lang AS business_tag, CASE WHEN doc_id % 3 = 0 THEN '通知' WHEN doc_id % 3 = 1 THEN '制度' ELSE '培养方案' END AS doc_type, concat(CAST(2022 + doc_id % 4 AS STRING), '-', CAST(2023 + doc_id % 4 AS STRING)) AS effective_date, CASE WHEN doc_id % 2 = 0 THEN '学院' ELSE '校区' END AS scope FROM {documents}"
ASKED = "SELECT item_id AS query_id, text AS query FROM {benchmark}"


TOKENS = token_pattern(TERMS, "Han")


def chunks(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, CHUNKS)


def asked(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, ASKED)


def gold(spark, sf_dir) -> DataFrame:
    """Benchmark passages with the sources and languages of the documents that contain them."""
    q, c = asked(spark, sf_dir), chunks(spark, sf_dir).select("text", "source_file", "business_tag")
    found = passages.holding(c, q).groupBy("query_id").agg(F.collect_set("source_file").alias("source_files"), F.collect_set("business_tag").alias("source_tags"))
    out = q.join(materialize(found, "found"), "query_id", "left")
    return out.select("query_id", "query", F.coalesce("source_files", F.array().cast("array<string>")).alias("source_files"), F.coalesce("source_tags", F.array().cast("array<string>")).alias("source_tags"), F.col("source_files").isNull().alias("negative_sample"), (F.col("query_id") % 4 == 0).alias("is_table_question"))


GOLD = """gold AS (SELECT b.item_id AS query_id, coalesce(list_sort(list(DISTINCT d.source) FILTER (d.doc_id IS NOT NULL)), []) AS source_files, coalesce(list_sort(list(DISTINCT d.lang) FILTER (d.doc_id IS NOT NULL)), []) AS source_tags, count(d.doc_id) = 0 AS negative_sample, b.item_id % 4 = 0 AS is_table_question
FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id)"""

BM25 = r"""tok AS (SELECT doc_id AS chunk, regexp_extract_all(lower(text), '@TOKENS@') AS ts FROM documents),
post AS (SELECT chunk, token, len AS length, count(*) AS tf FROM (SELECT chunk, len(ts) AS len, unnest(ts) AS token FROM tok) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(len(ts)) AS mean_length FROM tok),
raw AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, tot GROUP BY token),
stats AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
ask AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '@TOKENS@')) AS token FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, chunk, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM ask JOIN stats USING (token) JOIN post USING (token), tot GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 10)"""

CANDS = "cands AS (SELECT query_id, chunk, score, rank, source AS source_file, lang AS business_tag FROM bm25 JOIN documents d ON d.doc_id = bm25.chunk)"
CAPPED = "capped AS (SELECT query_id, chunk, score, source_file, business_tag, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) AS nth FROM cands) WHERE nth <= 2)"
DETAIL = """{0}_detail AS (SELECT g.query_id, g.is_table_question, coalesce(t.files, []) AS files, g.source_files AS want,
list_has_any(coalesce(t.files, [])[1:1], g.source_files) AS h1, list_has_any(coalesce(t.files, [])[1:3], g.source_files) AS h3, list_has_any(coalesce(t.files, [])[1:5], g.source_files) AS h5,
list_min(list_filter(list_transform(g.source_files, lambda s: list_position(coalesce(t.files, []), s)), lambda p: p > 0)) AS first_rank
FROM gold g LEFT JOIN (SELECT query_id, list(source_file ORDER BY rank) AS files FROM {0} WHERE rank <= 10 GROUP BY query_id) t USING (query_id) WHERE NOT g.negative_sample)"""
RECALL = """SELECT subset, k, round(avg(CAST(h AS DOUBLE)), 6) AS recall FROM (
SELECT 'all' AS subset, unnest([1, 3, 5]) AS k, unnest([h1, h3, h5]) AS h FROM {0}_detail UNION ALL
SELECT 'table', unnest([1, 3, 5]), unnest([h1, h3, h5]) FROM {0}_detail WHERE is_table_question) GROUP BY ALL"""


def with_(*parts: str) -> str:
    return ("WITH " + ", ".join(parts) + " ").replace("@TOKENS@", TOKENS)


_INDEXES: dict[tuple[str, str], str] = {}


def bm25_tables(spark, sf_dir) -> postings.Index:
    """The index of the chunks: written by the first search of an application, read by the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = new_path(spark, "bm25")
        postings.write_index(chunks(spark, sf_dir), path)
        _INDEXES[key] = path
    return postings.read_index(spark, _INDEXES[key])


def bm25_topk(spark, sf_dir) -> DataFrame:
    return postings.search(bm25_tables(spark, sf_dir), asked(spark, sf_dir)).select("query_id", "chunk", "score", "rank")


def bm25(spark, sf_dir) -> DataFrame:
    found = bm25_topk(spark, sf_dir)
    return materialize(found.join(chunks(spark, sf_dir).withColumnRenamed("doc_id", "chunk"), "chunk"), "candidates")


def details(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    g, c = gold(spark, sf_dir), bm25(spark, sf_dir)
    return evaluate.eval_detail(c, g), evaluate.eval_detail(rerank.dedup_by_source(c, 2), g), g


@query(with_(GOLD, BM25, CANDS, CAPPED, DETAIL.format("capped")) + RECALL.format("capped"))
def recall_bm25_capped(spark, sf_dir):
    return evaluate.recall_at_k(details(spark, sf_dir)[1])


@query(with_(BM25) + "SELECT token, df, round(idf, 6) AS idf FROM stats")
def bm25_index(spark, sf_dir):
    return bm25_tables(spark, sf_dir).terms.withColumn("idf", F.round("idf", 6))


@query()
def bm25_blocks(spark, sf_dir):
    """How many blocks hold a question's tokens, and how many of them the search reads."""
    return postings.searched(bm25_tables(spark, sf_dir), asked(spark, sf_dir))[1]


@query(with_(BM25) + "SELECT query_id, chunk, score, rank FROM bm25")
def bm25_top10(spark, sf_dir):
    return bm25_topk(spark, sf_dir)


@query(with_(GOLD) + "SELECT query_id, array_to_string(source_files, ',') AS files, array_to_string(source_tags, ',') AS tags, negative_sample, is_table_question FROM gold")
def gold_relation(spark, sf_dir):
    g = gold(spark, sf_dir)
    return g.select("query_id", F.array_join(F.array_sort("source_files"), ",").alias("files"), F.array_join(F.array_sort("source_tags"), ",").alias("tags"), "negative_sample", "is_table_question")


@query(with_(GOLD) + "SELECT count(*) FILTER (NOT negative_sample) AS total, count(*) FILTER (NOT negative_sample AND is_table_question) AS table_questions, count(*) FILTER (negative_sample) AS negatives FROM gold")
def eval_counts(spark, sf_dir):
    return evaluate.eval_counts(gold(spark, sf_dir))


@query(with_(GOLD, BM25, CANDS, DETAIL.format("cands")) + "SELECT query_id, is_table_question, array_to_string(files[1:5], ',') AS top_files, h1, h3, h5, first_rank FROM cands_detail")
def eval_detail(spark, sf_dir):
    d = details(spark, sf_dir)[0]
    return d.select("query_id", "is_table_question", F.array_join("top_files", ",").alias("top_files"), *[F.col("hit")[k].alias(f"h{k}") for k in (1, 3, 5)], F.col("first_rank").cast("bigint").alias("first_rank"))


@query(with_(GOLD, BM25, CANDS, DETAIL.format("cands")) + "SELECT 'miss_at_3' AS kind, query_id FROM cands_detail WHERE NOT h3 UNION ALL (SELECT 'late', query_id FROM cands_detail WHERE h3 AND NOT h1 ORDER BY query_id LIMIT 10) UNION ALL (SELECT 'negative', query_id FROM gold WHERE negative_sample ORDER BY query_id LIMIT 10)")
def miss_report(spark, sf_dir):
    d, _, g = details(spark, sf_dir)
    return evaluate.miss_report(d, g)


COMPARED = """compared AS (SELECT a.query_id, CASE WHEN NOT a.h1 AND b.h1 THEN 'improved_top1' WHEN NOT a.h3 AND b.h3 THEN 'improved_top3' WHEN a.h1 AND NOT b.h1 THEN 'regressed_top1' WHEN a.h3 AND NOT b.h3 THEN 'regressed_top3' ELSE 'unchanged' END AS change,
CASE WHEN a.first_rank <= 5 AND b.first_rank <= 5 THEN a.first_rank - b.first_rank END AS rank_change FROM cands_detail a JOIN capped_detail b USING (query_id))"""
_BOTH = with_(GOLD, BM25, CANDS, CAPPED, DETAIL.format("cands"), DETAIL.format("capped"), COMPARED)


@query(_BOTH + "SELECT query_id, change, CAST(rank_change AS BIGINT) AS rank_change FROM compared")
def compare_runs(spark, sf_dir):
    a, b, _ = details(spark, sf_dir)
    return evaluate.compare_runs(a, b).withColumn("rank_change", F.col("rank_change").cast("bigint"))


@query(_BOTH + "SELECT change, count(*) AS n FROM compared GROUP BY change")
def change_counts(spark, sf_dir):
    a, b, _ = details(spark, sf_dir)
    return evaluate.change_counts(evaluate.compare_runs(a, b))


@query(_BOTH + "SELECT subset, k, a.recall AS base, b.recall AS other, round(b.recall - a.recall, 6) AS delta FROM (" + RECALL.format("cands") + ") a JOIN (" + RECALL.format("capped") + ") b USING (subset, k)")
def metric_deltas(spark, sf_dir):
    a, b, _ = details(spark, sf_dir)
    return evaluate.metric_deltas(evaluate.recall_at_k(a), evaluate.recall_at_k(b))


@query(with_(GOLD, BM25, CANDS) + "SELECT g.query_id, CAST(min(rank) AS BIGINT) AS found_rank FROM gold g LEFT JOIN cands c ON g.query_id = c.query_id AND rank <= 5 AND list_contains(source_files, source_file) GROUP BY g.query_id")
def find_rank(spark, sf_dir):
    return evaluate.first_rank_within(bm25(spark, sf_dir), gold(spark, sf_dir)).withColumn("found_rank", F.col("found_rank").cast("bigint"))


# Each question names its own source with a letter too many; every second one also a real file and an unlike one.
WANTED_FILES = "SELECT item_id AS query_id, concat('src', CAST(item_id % 23 AS STRING), 'x') AS f, CASE WHEN item_id % 2 = 0 THEN 'src2' END AS real, CASE WHEN item_id % 2 = 0 THEN 'doc' END AS unlike FROM {benchmark}"


@query("WITH w AS (" + WANTED_FILES + "), files AS (SELECT query_id, unnest([f, real, unlike]) AS source_file FROM w), names AS (SELECT DISTINCT source AS name FROM documents), near AS (SELECT DISTINCT source_file, first_value(name) OVER (PARTITION BY source_file ORDER BY levenshtein(source_file, name), name) AS closest FROM (SELECT DISTINCT source_file FROM files WHERE source_file IS NOT NULL), names) SELECT query_id, source_file, closest FROM files JOIN near USING (source_file) WHERE source_file NOT IN (SELECT name FROM names)")
def validate_gold(spark, sf_dir):
    q = view(spark, sf_dir, WANTED_FILES).select("query_id", F.filter(F.array("f", "real", "unlike"), lambda x: x.isNotNull()).alias("source_files"))
    return evaluate.validate_gold(q, chunks(spark, sf_dir))


#: Names of parts with a letter gone, two changed, the halves swapped, or of no part at all.
MISSPELT = "SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN concat(substr(p_name, 1, 2), substr(p_name, 4)) WHEN 1 THEN concat('z', substr(p_name, 2, 3), 'q', substr(p_name, 6)) WHEN 2 THEN concat(substr(p_name, 5), substr(p_name, 1, 4)) ELSE concat('~', CAST(p_partkey AS STRING)) END AS wanted FROM {part} WHERE p_partkey % 40 < 4"


@query("WITH w AS (" + MISSPELT + "), n AS (SELECT DISTINCT p_name AS name FROM part) SELECT wanted, CAST(m.d AS INT) AS d, m.name AS name FROM (SELECT wanted, min({'d': levenshtein(wanted, name), 'name': name}) AS m FROM w, n GROUP BY wanted)")
def nearest_names(spark, sf_dir):
    """The nearest of all part names to names that are misspelt."""
    return names.nearest_names(view(spark, sf_dir, MISSPELT), table(spark, sf_dir, "part").select("p_name"))


# Dense legs over the embeddings: every 25th vector asks, the others are the corpus.
VECTORS = "SELECT vec_id AS chunk, embedding AS vector, label AS tag FROM {embeddings} WHERE vec_id % 25 <> 0"
VECTOR_QUERIES = "SELECT vec_id AS query_id, embedding AS vector, label AS tag FROM {embeddings} WHERE vec_id % 25 = 0"


def vectors(spark, sf_dir, dims: int = 64) -> tuple[DataFrame, DataFrame]:
    q, v = view(spark, sf_dir, VECTOR_QUERIES), view(spark, sf_dir, VECTORS)
    return tuple(d.withColumn("vector", F.slice("vector", 1, dims)) for d in (q, v))


_CELLS: dict[tuple, pivots.Cells] = {}


def nearest(spark, sf_dir, k: int, dims: int = 64, tag: str | None = None) -> DataFrame:
    """The vectors' cells are built by the first search of an application."""
    q, v = vectors(spark, sf_dir, dims)
    key = (spark.sparkContext.applicationId, sf_dir, dims, tag)
    if key not in _CELLS:
        _CELLS[key] = pivots.build(v, tag=tag)
    return pivots.search(_CELLS[key], q, k, tag)


@query()
def knn_cells(spark, sf_dir):
    """How many cells there are for each query, and how many of them the search visits."""
    q, v = vectors(spark, sf_dir)
    return pivots.searched(pivots.build(v), q, 10)[1]


def _knn(dims: int, k: int, extra: str = "") -> str:
    return f"(SELECT query_id, chunk, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank, tag, own FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk, v.label AS tag, q.label AS own, round(list_cosine_similarity(CAST(q.embedding[1:{dims}] AS DOUBLE[]), CAST(v.embedding[1:{dims}] AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 25 = 0 AND v.vec_id % 25 <> 0 {extra}) QUALIFY rank <= {k})"


@query(f"SELECT query_id, chunk, score, rank FROM {_knn(64, 10)}")
def knn_top10(spark, sf_dir):
    return nearest(spark, sf_dir, 10).select("query_id", "chunk", "score", "rank")


@query(f"SELECT query_id, chunk, score, rank FROM {_knn(64, 5, 'AND q.label = v.label')}")
def knn_filtered(spark, sf_dir):
    return nearest(spark, sf_dir, 5, tag="tag").select("query_id", "chunk", "score", "rank")


@query(f"SELECT query_id, chunk, round(1 - (1 - score), 6) AS score FROM {_knn(64, 3)}")
def similarity_scores(spark, sf_dir):
    found = nearest(spark, sf_dir, 3).withColumn("distance", 1 - F.col("score")).drop("score")
    return dense.with_similarity(found).select("query_id", "chunk", F.round("score", 6).alias("score"))


def legs(spark, sf_dir) -> DataFrame:
    a, b = (nearest(spark, sf_dir, 10, d).withColumn("leg", F.lit(n)) for n, d in ((1, 64), (2, 32)))
    return a.unionByName(b).withColumnRenamed("chunk", "key")


LEGS = f"legs AS (SELECT 1 AS leg, query_id, chunk AS key, score, rank FROM {_knn(64, 10)} UNION ALL SELECT 2, query_id, chunk, score, rank FROM {_knn(32, 10)})"
_ORDERED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, key) AS rank"
RRF = "SELECT query_id, key, score, {1} FROM (SELECT query_id, key, round(sum(1.0 / ({0} + rank)), 9) AS score, min([leg, rank]) AS first FROM legs GROUP BY ALL) QUALIFY rank <= 10"
SCALED = "scaled AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM legs WINDOW w AS (PARTITION BY query_id, leg))"
WEIGHTED = "SELECT query_id, key, score, {2} FROM (SELECT query_id, key, round(sum(s * CASE leg WHEN 1 THEN {0} ELSE {1} END), 9) AS score, min([leg, rank]) AS first FROM scaled GROUP BY ALL) QUALIFY rank <= 10"


@query(with_(LEGS) + RRF.format(60, _ORDERED))
def rrf_fused(spark, sf_dir):
    return fuse.rrf_fuse(legs(spark, sf_dir))


@query(with_(LEGS, SCALED) + WEIGHTED.format(0.5, 0.5, _ORDERED))
def weighted_fused(spark, sf_dir):
    return fuse.hybrid(legs(spark, sf_dir), "weighted")


CONFIGS = [("first", None), ("second", None), ("rrf_20", 20), ("rrf_60", 60), ("weighted_3_7", (0.3, 0.7)), ("weighted_5_5", (0.5, 0.5)), ("weighted_7_3", (0.7, 0.3))]


def ablation(spark, sf_dir) -> DataFrame:
    """All configurations over the same two legs."""
    both, out = legs(spark, sf_dir), None
    for label, how in CONFIGS:
        if how is None:
            one = both.where(F.col("leg") == (1 if label == "first" else 2)).select("query_id", "key", "score", "rank")
        else:
            one = fuse.rrf_fuse(both, k=how) if isinstance(how, int) else fuse.weighted_fuse(both, {1: how[0], 2: how[1]})
        one = one.withColumn("label", F.lit(label))
        out = one if out is None else out.unionByName(one)
    tags = view(spark, sf_dir, VECTORS).select(F.col("chunk").alias("key"), F.col("tag").cast("string").alias("business_tag"), F.lit("").alias("source_file"))
    # Dealt by what follows groups on; a union's branches must not be taken for one partitioning.
    return out.repartition("label", "query_id").join(tags, "key")


def vector_gold(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, VECTOR_QUERIES).select("query_id", F.lit(None).cast("array<string>").alias("source_files"), F.array(F.col("tag").cast("string")).alias("source_tags"), F.lit(False).alias("negative_sample"), (F.col("query_id") % 4 == 0).alias("is_table_question"))


def ablation_recall(spark, sf_dir) -> DataFrame:
    labels = spark.createDataFrame([(c,) for c, _ in CONFIGS], "label string")
    return evaluate.recall_at_k(evaluate.eval_detail(ablation(spark, sf_dir), vector_gold(spark, sf_dir), by=("label",), labels=labels), ("label",))


def _config_sql(label, how) -> str:
    if how is None:
        return f"SELECT '{label}' AS label, query_id, key, rank FROM legs WHERE leg = {1 if label == 'first' else 2}"
    inner = RRF.format(how, _ORDERED) if isinstance(how, int) else WEIGHTED.format(*how, _ORDERED)
    return f"SELECT '{label}' AS label, query_id, key, rank FROM ({inner})"


ABLATION = with_(LEGS, SCALED, "runs AS (" + " UNION ALL ".join(_config_sql(*c) for c in CONFIGS) + ")", "hits AS (SELECT label, query_id, k, max(CASE WHEN rank <= k AND v.label_v = q.label_q THEN 1 ELSE 0 END) AS h FROM runs JOIN (SELECT vec_id AS key, label AS label_v FROM embeddings) v USING (key) JOIN (SELECT vec_id AS query_id, label AS label_q FROM embeddings) q USING (query_id), (SELECT unnest([1, 3, 5]) AS k) GROUP BY ALL)", "recall AS (SELECT label, 'all' AS subset, k, round(avg(h), 6) AS recall FROM hits GROUP BY ALL UNION ALL SELECT label, 'table', k, round(avg(h), 6) FROM hits WHERE query_id % 4 = 0 GROUP BY ALL)")


@query(ABLATION + "SELECT label, subset, k, recall FROM recall", name="ablation_recall")
def _ablation(spark, sf_dir):
    return ablation_recall(spark, sf_dir)


@query(ABLATION + "SELECT label, recall FROM recall JOIN (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i})" for i, (c, _) in enumerate(CONFIGS)) + ") AS t(label, place)) USING (label) WHERE subset = 'all' AND k = 3 ORDER BY recall DESC, place LIMIT 1")
def best_config(spark, sf_dir):
    places = spark.createDataFrame([(c, i) for i, (c, _) in enumerate(CONFIGS)], "label string, place int")
    return evaluate.best_config(ablation_recall(spark, sf_dir), places)


@query(ABLATION + "SELECT a.subset, a.k, a.recall AS first, b.recall AS second, round(b.recall - a.recall, 6) AS delta FROM recall a JOIN recall b ON a.subset = b.subset AND a.k = b.k AND a.label = 'first' AND b.label = 'second'")
def compare_models(spark, sf_dir):
    return evaluate.compare_models(ablation_recall(spark, sf_dir).withColumnRenamed("label", "model"), ("first", "second"))


# Query variants: the first and the last half of a passage's characters.
VARIANTS = "SELECT item_id AS query_id, substr(text, 1, CAST(floor(length(text) / 2) AS INT)) AS v1, substr(text, CAST(floor(length(text) / 2) AS INT) + 1) AS v2 FROM {benchmark}"


@query("WITH v AS (" + VARIANTS + "), e AS (SELECT item_id AS query_id, 0 AS place, text AS query, 3.0 AS weight FROM benchmark UNION ALL SELECT query_id, 1, v1, 1.0 FROM v UNION ALL SELECT query_id, 2, v2, 1.0 FROM v) SELECT query_id, place, query, CAST(weight AS DOUBLE) AS weight FROM e")
def expanded_queries(spark, sf_dir):
    v = view(spark, sf_dir, VARIANTS).select("query_id", F.array("v1", "v2").alias("variants"))
    return fuse.expand_queries(asked(spark, sf_dir), v)


def _cache(spark, sf_dir) -> DataFrame:
    v = view(spark, sf_dir, VARIANTS).where("query_id % 3 <> 0").select("query_id", F.array("v1", "v2").alias("variants"))
    return asked(spark, sf_dir).join(v, "query_id").select(F.md5("query").alias("key"), "variants")


@query("SELECT item_id AS query_id, md5(text) AS key, item_id % 3 <> 0 AS hit FROM benchmark")
def variant_cache(spark, sf_dir):
    hits, misses = fuse.resolve_variants(asked(spark, sf_dir), _cache(spark, sf_dir))
    return hits.select("query_id", "key", F.lit(True).alias("hit")).unionByName(misses.select("query_id", "key", F.lit(False).alias("hit")))


@query("SELECT item_id AS query_id, false AS first_run, md5(text) IN (SELECT md5(text) FROM benchmark WHERE item_id % 3 <> 0) AS second_run, true AS third_run, false AS cleared FROM benchmark")
def variant_store(spark, sf_dir):
    """Whether each question's variants are in the store: at first, after two thirds and then the misses were appended, cleared."""
    store, q = VariantStore(spark, new_path(spark, "variants")), asked(spark, sf_dir)
    v = view(spark, sf_dir, VARIANTS).select("query_id", F.array("v1", "v2").alias("variants"))
    runs = []
    for change in (lambda m: store.append(m.where("query_id % 3 <> 0").join(v, "query_id")), lambda m: store.append(m.join(v, "query_id")), lambda m: store.clear(), None):
        hits, misses = store.resolve(q)
        runs.append(hits.select("query_id", F.lit(True).alias("hit")))
        if change:
            change(misses)
    out = q.select("query_id")
    for name, hits in zip(("first_run", "second_run", "third_run", "cleared"), runs):
        out = out.join(hits.withColumnRenamed("hit", name), "query_id", "left").na.fill(False, [name])
    return out


FORMS = "forms AS (SELECT item_id * 10 AS item_id, text FROM benchmark UNION ALL SELECT query_id * 10 + 1, v1 FROM (" + VARIANTS + ") WHERE v1 NOT IN (SELECT text FROM benchmark WHERE item_id = query_id) UNION ALL SELECT query_id * 10 + 2, v2 FROM (" + VARIANTS + ") WHERE v2 <> v1)"
_FORM_LEGS = "legs AS (SELECT query_id // 10 AS query_id, query_id % 10 AS leg, chunk AS key, score, rank FROM bm25)"


@query(with_(FORMS, BM25.replace("FROM benchmark", "FROM forms"), _FORM_LEGS, SCALED) + "SELECT query_id, key, score, {2} FROM (SELECT query_id, key, round(sum(s * CASE leg WHEN 0 THEN 3.0 ELSE 1.0 END), 9) AS score, min([leg, rank]) AS first FROM scaled GROUP BY ALL) QUALIFY rank <= 10".replace("{2}", _ORDERED))
def rewrite_search(spark, sf_dir):
    """Every query form searched once by BM25, its hits weighted by the form and fused."""
    v = view(spark, sf_dir, VARIANTS).select("query_id", F.array("v1", "v2").alias("variants"))
    forms = fuse.expand_queries(asked(spark, sf_dir), v).withColumn("form", F.col("query_id") * 10 + F.col("place"))
    found = postings.search(bm25_tables(spark, sf_dir), forms.select(F.col("form").alias("query_id"), "query"))
    back = found.select(F.floor(F.col("query_id") / 10).cast("bigint").alias("query_id"), (F.col("query_id") % 10).cast("int").alias("leg"), F.col("chunk").alias("key"), "score", "rank")
    return fuse.multi_query(back)


# Candidates with questions that carry the signals of the boosts.
_SIGNAL = "concat(CASE WHEN query_id % 3 = 0 THEN '本学期报名截止 ' WHEN query_id % 3 = 1 THEN '计算机学院 2024-2025 申请 ' ELSE '' END, CASE WHEN query_id % 2 = 0 THEN '奖学金 ' ELSE '' END)"
_TAGGED = "CASE WHEN chunk % 2 = 0 THEN '奖学金' ELSE '考试' END"


def candidates(spark, sf_dir) -> DataFrame:
    c = bm25(spark, sf_dir).join(asked(spark, sf_dir), "query_id")
    return c.withColumns({"query": F.concat(F.expr(_SIGNAL), F.col("query")), "business_tag": F.expr(_TAGGED)})


_RERANK = f"asking AS (SELECT item_id AS query_id, text AS query FROM benchmark), c AS (SELECT query_id, chunk, rank, source AS source_file, d.text, concat({_SIGNAL}, query) AS query, {_TAGGED} AS tag, doc_id % 3 = 0 AS notice, concat(CAST(2022 + doc_id % 4 AS STRING), '-', CAST(2023 + doc_id % 4 AS STRING)) AS eff, doc_id % 2 = 0 AS college FROM @BASE@ JOIN documents d ON d.doc_id = chunk JOIN asking USING (query_id)), s AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '@TOKENS@')) AS q, regexp_extract_all(lower(text), '@TOKENS@') AS t FROM c), r AS (SELECT *, round(len(list_intersect(q, t)) / len(q), 6) AS rerank_score FROM s), r10 AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank FROM r)"
RERANKED = with_(BM25, _RERANK.replace("@BASE@", "bm25"))


@query(RERANKED + "SELECT query_id, chunk, rerank_score, rank FROM r10 WHERE rank <= 5")
def reranked(spark, sf_dir):
    return rerank.rerank(candidates(spark, sf_dir)).select("query_id", "chunk", "rerank_score", "rank")


@query(RERANKED + "SELECT query_id, chunk, new_rank AS rank FROM (SELECT query_id, chunk, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) AS nth FROM r10) WHERE nth <= 2) WHERE new_rank <= 5")
def retrieve_chain(spark, sf_dir):
    return rerank.retrieve(candidates(spark, sf_dir)).select("query_id", "chunk", "rank")


def _boost_sql(active: str, add: str) -> str:
    return RERANKED + f", b AS (SELECT *, CASE WHEN {active} THEN {add} END AS boost FROM r10) SELECT query_id, chunk, CASE WHEN boost IS NULL THEN rerank_score ELSE round(rerank_score + boost, 6) END AS rerank_score, boost AS metadata_boost, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN boost IS NOT NULL THEN -round(rerank_score + boost, 6) END, rank) AS rank FROM b"


def _boosted(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk", "rerank_score", F.round("metadata_boost", 6).alias("metadata_boost"), "rank")


@query(_boost_sql("query_id % 3 = 0 AND query_id % 2 = 0", "CASE WHEN notice AND tag = '奖学金' THEN 0.08 + CASE WHEN eff = '2025-2026' THEN 0.02 ELSE 0 END ELSE 0 END").replace("boost AS metadata_boost", "CAST(round(boost, 6) AS DOUBLE) AS metadata_boost"))
def topic_boosted(spark, sf_dir):
    return _boosted(rerank.topic_boost(rerank.rerank(candidates(spark, sf_dir), top_n=10)))


@query(_boost_sql("query_id % 3 <= 1", "(CASE WHEN notice THEN 0.3 ELSE 0 END + CASE WHEN notice AND query_id % 3 = 1 AND eff = '2024-2025' THEN 0.1 ELSE 0 END + CASE WHEN query_id % 3 = 1 AND college THEN 0.2 ELSE 0 END)").replace("boost AS metadata_boost", "CAST(round(boost, 6) AS DOUBLE) AS metadata_boost"))
def metadata_boosted(spark, sf_dir):
    return _boosted(rerank.metadata_boost(rerank.rerank(candidates(spark, sf_dir), top_n=10)))


@query(with_(BM25, CANDS, CAPPED) + "SELECT query_id, chunk, rank FROM capped")
def capped_by_source(spark, sf_dir):
    return rerank.dedup_by_source(bm25(spark, sf_dir), 2).select("query_id", "chunk", "rank")


def hashed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, n): the tokens of each text, dealt to 64 buckets by their md5."""
    d = texts.select(key, F.explode(words(F.col(text))).alias("w"))
    return d.groupBy(key, (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint") % 64).alias("bucket")).agg(F.count("*").alias("n"))


def md5_buckets(tokens: pa.Array) -> np.ndarray:
    """The bucket of each token: the first eight hex digits of its md5, of which the fourth byte counts, modulo 64."""
    tokens = tokens.cast(pa.large_binary())
    ends = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1].tolist() if len(tokens) else [0]
    data = tokens.buffers()[2].to_pybytes() if len(tokens) and tokens.buffers()[2] else b""
    return np.array([hashlib.md5(data[i:j], usedforsecurity=False).digest()[3] for i, j in zip(ends, ends[1:])], np.int64) % 64


def hashed_vector(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, vector) of 64 counts of each text that has tokens; keys are unique. A task hashes each token of a batch once."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ts = part.column("ts")
                found, n = ts.flatten().dictionary_encode(), pc.list_value_length(ts).to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(len(n)), n) * 64 + md5_buckets(found.dictionary)[found.indices.to_numpy(zero_copy_only=False)]
                counts = np.bincount(at, minlength=64 * len(n)).astype(np.float64)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * len(n) + 1, 64, dtype=np.int32)), pa.array(counts))
                yield pa.RecordBatch.from_arrays([part.column("key"), vectors], names=[key, "vector"])

    d = texts.select(F.col(key).alias("key"), words(F.col(text)).alias("ts")).where(F.size("ts") > 0)
    return d.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, vector array<double>")


HASHED = "counted AS (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % 64 AS bucket FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '@TOKENS@')) AS w FROM documents)) GROUP BY ALL)"


@query(with_(HASHED) + "SELECT doc_id, count(*) AS buckets, round(max(n) / sqrt(sum(n * n)), 6) AS top FROM counted GROUP BY doc_id")
def hashed_vectors(spark, sf_dir):
    c = hashed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("buckets"), F.round(F.max("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")), 6).alias("top"))


def text_legs(spark, sf_dir) -> DataFrame:
    """BM25 and dense search over the documents, the latter by hashed token vectors, which the index's postings make."""
    lexical_leg = bm25_topk(spark, sf_dir).withColumn("leg", F.lit(1))
    q, v = hashed_vector(asked(spark, sf_dir), "query_id", "query"), postings.token_vectors(bm25_tables(spark, sf_dir), md5_buckets, 64)
    near = dense.knn_topk(q, v, 10)
    return materialize(lexical_leg.unionByName(near.withColumn("leg", F.lit(2))), "text-legs").withColumnRenamed("chunk", "key")


ASKED_HASHED = HASHED.replace("counted AS", "asked_counts AS").replace("doc_id", "query_id").replace("FROM documents", "FROM (SELECT item_id AS query_id, text FROM benchmark)")
DENSE_TEXT = "near AS (SELECT query_id, doc_id AS chunk, round(sum(a.n * c.n) / sqrt(any_value(qn) * any_value(dn)), 6) AS score FROM (SELECT *, sum(n * n) OVER (PARTITION BY query_id) AS qn FROM asked_counts) a JOIN (SELECT *, sum(n * n) OVER (PARTITION BY doc_id) AS dn FROM counted) c USING (bucket) GROUP BY ALL), dense_text AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM near QUALIFY rank <= 10)"
TEXT_LEGS = "legs AS (SELECT 1 AS leg, query_id, chunk AS key, score, rank FROM bm25 UNION ALL SELECT 2, query_id, chunk, score, rank FROM dense_text)"
_HYBRID = (BM25, HASHED, ASKED_HASHED, DENSE_TEXT, TEXT_LEGS)


@query(with_(*_HYBRID) + RRF.format(60, _ORDERED))
def hybrid_search(spark, sf_dir):
    """BM25 and dense legs over one corpus, fused by reciprocal ranks."""
    return fuse.hybrid(text_legs(spark, sf_dir))


@query(with_(*_HYBRID, "fused AS (" + RRF.format(60, _ORDERED) + ")", "base AS (SELECT query_id, key AS chunk, rank FROM fused)", _RERANK.replace("@BASE@", "base")) + "SELECT query_id, chunk, new_rank AS rank FROM (SELECT query_id, chunk, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) AS nth FROM r10) WHERE nth <= 2) WHERE new_rank <= 5")
def hybrid_chain(spark, sf_dir):
    """The whole chain: both legs, fusion, rerank, cap."""
    fused = fuse.hybrid(text_legs(spark, sf_dir)).withColumnRenamed("key", "chunk").select("query_id", "chunk", "rank")
    c = fused.join(chunks(spark, sf_dir).withColumnRenamed("doc_id", "chunk"), "chunk").join(asked(spark, sf_dir), "query_id")
    c = c.withColumns({"query": F.concat(F.expr(_SIGNAL), F.col("query")), "business_tag": F.expr(_TAGGED)})
    return rerank.retrieve(c).select("query_id", "chunk", "rank")


def _with_sources(spark, sf_dir, found: DataFrame) -> DataFrame:
    return found.join(chunks(spark, sf_dir).select(F.col("doc_id").alias("key"), "source_file", "business_tag"), "key")


_SOURCED = "SELECT query_id, key AS chunk, score, rank, source AS source_file, lang AS business_tag FROM {0} JOIN documents d ON d.doc_id = key"


@query(with_(GOLD, *_HYBRID, "fused AS (" + RRF.format(60, _ORDERED) + ")", "dense_run AS (" + _SOURCED.format("(SELECT * FROM legs WHERE leg = 2)") + ")", "fused_run AS (" + _SOURCED.format("fused") + ")", DETAIL.format("dense_run"), DETAIL.format("fused_run")) + "SELECT a.query_id, CAST(b.first_rank AS BIGINT) AS first_rank FROM dense_run_detail a JOIN fused_run_detail b USING (query_id) WHERE NOT a.h3 AND b.h3")
def fix_cases(spark, sf_dir):
    """Questions that the dense leg misses in its first three and the fusion doesn't."""
    g, both = gold(spark, sf_dir), text_legs(spark, sf_dir)
    a, b = (evaluate.eval_detail(_with_sources(spark, sf_dir, r), g) for r in (both.where("leg = 2").drop("leg"), fuse.hybrid(both)))
    return evaluate.fix_cases(a, b).withColumn("first_rank", F.col("first_rank").cast("bigint"))


def _letters(texts: list[str]) -> tuple[list[list[float]], int]:
    """A small deterministic model: letter frequencies; it bills a token for four characters."""
    return [[t.count(c) / max(len(t), 1) for c in "etaoinsh"] for t in texts], sum(len(t) // 4 for t in texts)


@query()
def embedded_corpus(spark, sf_dir):
    """What embedding the documents has used."""
    return dense.embed_stats(dense.embed_corpus(table(spark, sf_dir, "documents"), _letters, 8, "doc_id")).drop("seconds", "seconds_a_call")


def _letter(c: str) -> str:
    return f"round((length(t) - length(replace(t, '{c}', ''))) / length(t), 6)"


@query(f"SELECT doc_id, trim(t, ' ' || chr(10)) = '' AS failed, {_letter('e')} AS e, {_letter('h')} AS h FROM (SELECT doc_id, substr(text, 1, 2000) AS t FROM documents)")
def embedded_texts(spark, sf_dir):
    """The embedding of each text."""
    v = dense.embed_corpus(table(spark, sf_dir, "documents"), _letters, 8, "doc_id")
    return v.select("doc_id", "failed", F.round(F.get("vector", F.lit(0)), 6).alias("e"), F.round(F.get("vector", F.lit(7)), 6).alias("h"))


# The production chain step by step over both legs: each configuration once, legs, fusions and pair scores shared.
CHAINS = [
    evaluate.Config("vector", leg=2), evaluate.Config("bm25", leg=1), evaluate.Config("rrf_k20", rrf=20), evaluate.Config("rrf_k60", rrf=60), evaluate.Config("weighted_03_07", weights=(0.3, 0.7)),
    evaluate.Config("weighted_05_05", weights=(0.5, 0.5)), evaluate.Config("weighted_07_03", weights=(0.7, 0.3)), evaluate.Config("rerank", weights=(0.5, 0.5), rerank=True, top_k=5),
    evaluate.Config("rerank_dedup2", weights=(0.5, 0.5), rerank=True, max_per_source=2, top_k=5), evaluate.Config("rerank_dedup2_boost", weights=(0.5, 0.5), rerank=True, max_per_source=2, boost=True, top_k=5),
]


def chain_runs(spark, sf_dir) -> DataFrame:
    described = chunks(spark, sf_dir).withColumnRenamed("doc_id", "key")
    questions = asked(spark, sf_dir).withColumn("query", F.concat(F.expr(_SIGNAL), F.col("query")))
    return evaluate.ablate(text_legs(spark, sf_dir), CHAINS, described, questions)


def _chain_sql() -> str:
    parts, plain = [BM25, HASHED, ASKED_HASHED, DENSE_TEXT, TEXT_LEGS, SCALED, GOLD], "SELECT query_id, source AS source_file, rank FROM ({0}) JOIN documents d ON d.doc_id = key"
    weighted = lambda a, b: WEIGHTED.format(a, b, _ORDERED)
    runs = {"vector": "SELECT query_id, key, rank FROM legs WHERE leg = 2", "bm25": "SELECT query_id, key, rank FROM legs WHERE leg = 1", "rrf_k20": RRF.format(20, _ORDERED), "rrf_k60": RRF.format(60, _ORDERED), "weighted_03_07": weighted(0.3, 0.7), "weighted_05_05": weighted(0.5, 0.5), "weighted_07_03": weighted(0.7, 0.3)}
    parts += [f"run_{label} AS ({plain.format(sql)})" for label, sql in runs.items()]
    parts += ["base AS (SELECT query_id, key AS chunk, rank FROM (" + weighted(0.5, 0.5) + "))", _RERANK.replace("@BASE@", "base"), "run_rerank AS (SELECT query_id, source_file, rank FROM r10 WHERE rank <= 5)"]
    boost = "CASE WHEN notice THEN 0.3 ELSE 0 END + CASE WHEN notice AND query_id % 3 = 1 AND eff = '2024-2025' THEN 0.1 ELSE 0 END + CASE WHEN query_id % 3 = 1 AND college THEN 0.2 ELSE 0 END"
    parts.append(f"b10 AS (SELECT query_id, source_file, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id % 3 <= 1 THEN -round(rerank_score + {boost}, 6) END, rank) AS rank FROM r10)")
    capped = "{0} AS (SELECT query_id, source_file, new_rank AS rank FROM (SELECT query_id, source_file, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) AS nth FROM {1}) WHERE nth <= 2) WHERE new_rank <= 5)"
    parts += [capped.format("run_rerank_dedup2", "r10"), capped.format("run_rerank_dedup2_boost", "b10")]
    labels = [c.label for c in CHAINS]
    parts += [DETAIL.format(f"run_{x}") for x in labels]
    return with_(*parts) + " UNION ALL ".join(f"SELECT '{x}' AS label, subset, k, recall FROM (" + RECALL.format(f"run_{x}") + ")" for x in labels)


@query(_chain_sql())
def chain_ablation(spark, sf_dir):
    """Recall of both legs, their fusions, and the chain with reranking, a cap by source and the boost, in one job."""
    labels = spark.createDataFrame([(c.label,) for c in CHAINS], "label string")
    return evaluate.recall_at_k(evaluate.eval_detail(chain_runs(spark, sf_dir), gold(spark, sf_dir), by=("label",), labels=labels), ("label",))
