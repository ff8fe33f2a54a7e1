"""Evaluation of retrieval and answers: recall, ablations, comparisons of runs, latency. gold is (query_id, source_files,
source_tags, is_table_question, negative_sample); cands are ranked rows with source_file and business_tag."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from . import rerank
from .ground import stated
from .names import nearest_names
from .percentiles import exact_percentiles


def validate_gold(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, source_file, closest): gold files that the corpus lacks, with the nearest real name (of the first on ties)."""
    names = corpus.select(F.col("source_file").alias("name")).distinct()
    wanted = gold.select("query_id", F.explode("source_files").alias("source_file"))
    missing = wanted.join(names, F.col("source_file") == F.col("name"), "left_anti")
    near = nearest_names(missing.select("source_file"), names).select(F.col("wanted").alias("source_file"), F.col("name").alias("closest"))
    return missing.join(near, "source_file", "left").select("query_id", "source_file", "closest")


def eval_detail(cands: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5), fetched: int = 10, by: tuple[str, ...] = (), labels: DataFrame | None = None) -> DataFrame:
    """One row for each question that is no negative sample: top five files and tags, match mode, hit by k, first_rank.

    by names the columns of a run's label; labels lists the runs (few), so that a run without candidates counts as misses."""
    if max(ks) > fetched:
        raise ValueError("k is more than was fetched")
    top = cands.where(F.col("rank") <= fetched).groupBy(*by, "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_file", "business_tag"))).alias("top"))
    asked = gold.where(~F.coalesce("negative_sample", F.lit(False)))
    if by:
        asked = asked.crossJoin(F.broadcast(labels))
    d = asked.join(top, [*by, "query_id"], "left")
    files = F.coalesce(F.transform("top", lambda t: t["source_file"]), F.array().cast("array<string>"))
    tags = F.coalesce(F.transform("top", lambda t: t["business_tag"]), F.array().cast("array<string>"))
    by_file = F.size(F.coalesce("source_files", F.array().cast("array<string>"))) > 0
    seen, want = F.when(by_file, files).otherwise(tags), F.when(by_file, F.col("source_files")).otherwise(F.coalesce("source_tags", F.array().cast("array<string>")))
    d = d.withColumns({"seen": seen, "want": want})
    hit = F.map_from_arrays(F.array(*[F.lit(k) for k in ks]), F.array(*[F.arrays_overlap(F.slice("seen", 1, k), F.col("want")) for k in ks]))
    first = F.array_min(F.filter(F.transform("seen", lambda s, i: F.when(F.array_contains("want", s), i + 1)), lambda i: i.isNotNull()))
    return d.select(*by, "query_id", "is_table_question", F.slice(files, 1, 5).alias("top_files"), F.slice(tags, 1, 5).alias("top_tags"), F.when(by_file, "file").otherwise("tag").alias("match_mode"), hit.alias("hit"), first.alias("first_rank"))


@dataclass(frozen=True)
class Config:
    """A configuration of the search: one leg, or a fusion of two; then reranking, a boost, a cap by source and a cut."""

    label: str
    leg: int | None = None
    rrf: int | None = None
    weights: tuple[float, float] | None = None
    fetch_k: int = 10
    rerank: bool = False
    boost: bool = False
    max_per_source: int | None = None
    top_k: int = 10

    def row(self) -> tuple:
        a, b = self.weights or (1.0, 1.0)
        return self.label, self.leg, self.rrf, a, b, self.fetch_k


def fuse_all(legs: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """(label, query_id, key, rank): what each configuration's leg or fusion of legs 1 and 2 fetches, all in one grouping."""
    table = legs.sparkSession.createDataFrame([c.row() for c in configs], "label string, only int, k int, first_weight double, second_weight double, fetch_k int")
    w = Window.partitionBy("query_id", "leg")
    score = F.coalesce("score", F.lit(0.0))
    low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    scaled = legs.withColumn("scaled", F.when(span > 0, (score - low) / span).otherwise(F.lit(1.0)))
    each = scaled.crossJoin(F.broadcast(table)).where("only IS NULL OR only = leg")  # a row a configuration
    weight = F.when(F.col("leg") == 1, F.col("first_weight")).otherwise(F.col("second_weight"))
    part = F.when(F.col("only").isNotNull(), -F.col("rank")).when(F.col("k").isNotNull(), 1.0 / (F.col("k") + F.col("rank"))).otherwise(F.col("scaled") * weight)
    fused = each.groupBy("label", "query_id", "key", "fetch_k").agg(F.round(F.sum(part), 9).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    order = Window.partitionBy("label", "query_id").orderBy(F.col("score").desc(), "first.leg", "first.rank", "key")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("fetch_k")).select("label", "query_id", "key", "rank")


def ablate(legs: DataFrame, configs: Sequence[Config], described: DataFrame, queries: DataFrame) -> DataFrame:
    """(label, query_id, key, rank, ...) of every configuration over the same legs (query_id, leg, rank, key, score).

    described (key, text, source_file, ...) and queries (query_id, query) are what reranking and boosts look at. A text is
    scored once for a question, whatever configurations rank it.
    """
    by = ("label", "query_id")
    named = lambda want: F.col("label").isin([c.label for c in configs if want(c)])
    rows = materialize(fuse_all(materialize(legs, "legs"), configs), "runs")
    pairs = rows.where(named(lambda c: c.rerank)).select("query_id", "key").distinct()
    texts = pairs.join(described.select("key", "text"), "key").join(queries.select("query_id", "query"), "query_id")
    scores = texts.select("query_id", "key", rerank.overlap_score(F.col("query"), F.col("text")).alias("pair_score"))
    rows = rows.join(described.drop("text"), "key").join(scores, ["query_id", "key"], "left").join(queries.select("query_id", "query"), "query_id")
    out = rows.where(named(lambda c: not c.rerank)).withColumn("rerank_score", F.lit(None).cast("double"))
    ranked = rerank.rerank(rows.where(named(lambda c: c.rerank)).withColumn("text", F.lit("")), lambda q, t: F.col("pair_score"), None, by).drop("text")
    boosted = rerank.metadata_boost(ranked.where(named(lambda c: c.boost)), by=by).drop("metadata_boost")
    out = out.unionByName(ranked.where(named(lambda c: c.rerank and not c.boost)).select(*out.columns)).unionByName(boosted.select(*out.columns))
    done = out.where(named(lambda c: c.max_per_source is None))
    for cap in {c.max_per_source for c in configs} - {None}:
        done = done.unionByName(rerank.dedup_by_source(out.where(named(lambda c: c.max_per_source == cap)), cap, by=by).select(*done.columns))
    cut = F.coalesce(*[F.when(F.col("label") == c.label, F.lit(c.top_k)) for c in configs])
    return done.where(F.col("rank") <= cut)


def recall_at_k(detail: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, subset, k, recall) over all questions and over those about tables; a subset without questions has no row."""
    rows = detail.select(*by, "is_table_question", F.explode("hit").alias("k", "hit"))
    both = rows.withColumn("subset", F.explode(F.when(F.col("is_table_question"), F.array(F.lit("all"), F.lit("table"))).otherwise(F.array(F.lit("all")))))
    return both.groupBy(*by, "subset", "k").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"))


def eval_counts(gold: DataFrame) -> DataFrame:
    negative = F.coalesce("negative_sample", F.lit(False))
    return gold.agg(F.count_if(~negative).alias("total"), F.count_if(~negative & F.col("is_table_question")).alias("table_questions"), F.count_if(negative).alias("negatives"))


def miss_report(detail: DataFrame, gold: DataFrame, most: int = 10) -> DataFrame:
    """(kind, query_id): top-3 misses; hits at 3 that miss at 1; negatives. The latter two are reports of the first `most`."""
    a = detail.where(~F.col("hit")[3]).select(F.lit("miss_at_3").alias("kind"), "query_id")
    b = detail.where(F.col("hit")[3] & ~F.col("hit")[1]).select(F.lit("late").alias("kind"), "query_id").orderBy("query_id").limit(most)
    c = gold.where("negative_sample").select(F.lit("negative").alias("kind"), "query_id").orderBy("query_id").limit(most)
    return a.unionByName(b).unionByName(c)


def best_config(recall: DataFrame, configs: DataFrame) -> DataFrame:
    """The label of best recall at 3; the first of configs (label, place) wins ties."""
    top = recall.where("subset = 'all' and k = 3").join(configs, "label")
    return top.orderBy(F.col("recall").desc(), "place").limit(1).select("label", "recall")


def fix_cases(base: DataFrame, other: DataFrame) -> DataFrame:
    """Questions that base misses at 3 and the other run hits."""
    return base.where(~F.col("hit")[3]).select("query_id").join(other.where(F.col("hit")[3]).select("query_id", "first_rank"), "query_id")


def compare_runs(base: DataFrame, other: DataFrame, within: int = 5) -> DataFrame:
    """(query_id, change, rank_change): how each question of base fares in the other run."""
    cols = lambda d, p: d.select("query_id", F.col("hit")[1].alias(p + "1"), F.col("hit")[3].alias(p + "3"), F.when(F.col("first_rank") <= within, F.col("first_rank")).alias(p + "r"))
    j = cols(base, "a").join(cols(other, "b"), "query_id", "left").na.fill(False, ["a1", "a3", "b1", "b3"])
    change = F.when(~F.col("a1") & F.col("b1"), "improved_top1").when(~F.col("a3") & F.col("b3"), "improved_top3").when(F.col("a1") & ~F.col("b1"), "regressed_top1").when(F.col("a3") & ~F.col("b3"), "regressed_top3").otherwise("unchanged")
    return j.select("query_id", change.alias("change"), (F.col("ar") - F.col("br")).alias("rank_change"))


def change_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("change").agg(F.count("*").alias("n"))


def metric_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(subset, k, base, other, delta) of two recall tables."""
    j = a.withColumnRenamed("recall", "base").join(b.withColumnRenamed("recall", "other"), ["subset", "k"])
    return j.select("subset", "k", "base", "other", F.round(F.col("other") - F.col("base"), 6).alias("delta"))


def compare_models(recall: DataFrame, models: tuple[str, str]) -> DataFrame:
    """Recall of two models side by side: recall is (model, subset, k, recall)."""
    wide = recall.groupBy("subset", "k").pivot("model", list(models)).agg(F.first("recall"))
    a, b = (F.col(f"`{m}`") for m in models)
    return wide.select("subset", "k", a.alias("first"), b.alias("second"), F.round(b - a, 6).alias("delta"))


def score_answers(answers: DataFrame) -> DataFrame:
    """answers (query_id, answer, expected_values, expected_conditions) with how many of each the answer states."""
    out = answers
    for kind in ("value", "condition"):
        hits = stated(answers, "query_id", f"expected_{kind}s", kind).withColumnRenamed("hits", f"{kind}s_hit")
        out = out.join(hits, "query_id", "left").na.fill(0, [f"{kind}s_hit"])
    return out


def _rate(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(a / F.when(b != 0, b), F.lit(0.0)), 4)


def hallucination_summary(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rates over scored answers (negative_sample, rejected, is_table_question, n_values, values_hit, n_conditions,
    conditions_hit, unsupported); an empty denominator gives 0. unsupported counts in the numerator only."""
    s = lambda c, when=None: F.coalesce(F.sum(F.when(when if when is not None else F.lit(True), F.col(c)).cast("double")), F.lit(0.0))
    neg = F.col("negative_sample")
    pos, tab = ~neg, ~neg & F.col("is_table_question")
    v, vh, c, ch, u = s("n_values", pos), s("values_hit", pos), s("n_conditions", pos), s("conditions_hit", pos), s("unsupported", pos)
    return scored.groupBy(*by).agg(
        F.count("*").alias("answers"), _rate(vh, v).alias("value_accuracy"), _rate(ch, c).alias("condition_coverage"), _rate((v - vh) + (c - ch) + u, v + c).alias("combined_rate"),
        _rate(F.count_if(neg & F.col("rejected")).cast("double"), F.count_if(neg)).alias("negative_rejection"), _rate(s("values_hit", tab), s("n_values", tab)).alias("table_value_accuracy"),
    )


def worst_answers(scored: DataFrame, most: int = 10) -> DataFrame:
    """The `most` answers with the most issues in question order; clean ones among them are left out."""
    issues = (F.col("n_values") - F.col("values_hit") + F.col("n_conditions") - F.col("conditions_hit") + F.col("unsupported")).alias("issues")
    return scored.select("query_id", issues).orderBy(F.col("issues").desc(), "query_id").limit(most).where("issues > 0")


def sample_questions(gold: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n questions that are no negatives, in the order of a seeded hash: the same on each run."""
    return gold.where(~F.coalesce("negative_sample", F.lit(False))).orderBy(F.md5(F.concat_ws(":", F.col("query_id"), F.lit(seed))), "query_id").limit(n)


def latency_report(results: DataFrame, measures: tuple[str, ...] = ("total_s", "retrieval_s", "llm_s"), by: tuple[str, ...] = ()) -> DataFrame:
    """Success rate, and mean, interpolated percentiles, least and greatest of each measure over successes."""
    ok, shares = F.col("success"), (0.5, 0.95, 0.99)
    aggs = [F.count("*").alias("requests"), F.round(F.avg(ok.cast("double")), 6).alias("success_rate")]
    for m in measures:
        v = F.when(ok, F.col(m).cast("double"))
        aggs += [F.round(F.avg(v), 6).alias(f"{m}_mean"), F.round(F.min(v), 6).alias(f"{m}_min"), F.round(F.max(v), 6).alias(f"{m}_max")]
    each = results.where(ok).select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("x"))
    found = exact_percentiles(each.select(*by, "x.measure", "x.v"), "v", shares, (*by, "measure"))
    pick = lambda m, p: F.round(F.max(F.when((F.col("measure") == m) & (F.col("share") == p), F.col("percentile"))), 6)
    wide = found.groupBy(*by).agg(*[pick(m, p).alias(f"{m}_p{round(100 * p)}") for m in measures for p in shares])
    summed = results.groupBy(*by).agg(*aggs)
    if not by:
        return summed.crossJoin(F.broadcast(wide))  # one row each
    keys = [F.col(c).alias(f"__{c}") for c in by]
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    wide = wide.select(*keys, *[c for c in wide.columns if c not in by])
    return summed.join(wide, same, "left").drop(*[f"__{c}" for c in by])


def token_report(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    ok = results.where("success")
    return ok.groupBy(*by).agg(F.sum("total_tokens").alias("tokens"), F.round(F.avg("total_tokens"), 6).alias("mean_tokens"))


def stage_share(results: DataFrame, stages: tuple[str, ...] = ("retrieval_s", "llm_s"), by: tuple[str, ...] = ()) -> DataFrame:
    """Each stage's part of the mean total time of successes."""
    ok = results.where("success")
    return ok.groupBy(*by).agg(*[F.round(F.coalesce(F.avg(s) / F.when(F.avg("total_s") != 0, F.avg("total_s")), F.lit(0.0)), 6).alias(f"{s}_share") for s in stages])


def failed_requests(results: DataFrame) -> DataFrame:
    return results.where(~F.col("success"))


def qa_eval_table(gold: DataFrame, answers: DataFrame, cands: DataFrame, first: int | None = None) -> DataFrame:
    """(query_id, question, answer, contexts, ground_truth) as an outside judge of answers takes them."""
    g = gold.orderBy("query_id").limit(first) if first else gold
    ctx = cands.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    return g.join(answers, "query_id").join(ctx, "query_id", "left").select("query_id", F.col("query").alias("question"), "answer", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), F.col("ground_truth"))


def first_rank_within(cands: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, found_rank): the first rank up to k of an expected file, else null."""
    want = gold.select("query_id", F.explode("source_files").alias("source_file"))
    got = cands.where(F.col("rank") <= k).join(want, ["query_id", "source_file"]).groupBy("query_id").agg(F.min("rank").alias("found_rank"))
    return gold.select("query_id").join(got, "query_id", "left")


