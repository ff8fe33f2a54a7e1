"""Citations, fallbacks, fact checks and answer evaluation over conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rules import FALLBACK_ANSWER
from ..operators import evaluate, ground
from .registry import query, table, view

# Views: assistant turns, whole, as answers that go on to claim numbers taken from their text; evidence states others of it.
_CLAIMED = "CAST(160 + length(text) % 3 AS STRING)"
_TRUE = "CAST(160 + length(replace(text, 'a', '')) % 3 AS STRING)"
_TOP, _TRUE_TOP = "CAST(10 * (1 + length(text) % 2) AS STRING)", "CAST(10 * (1 + length(replace(text, 'e', '')) % 2) AS STRING)"
ANSWERS = f"SELECT conv_id * 1000 + turn AS query_id, CASE WHEN conv_id % 9 = 0 THEN '转专业怎么办' ELSE text END AS query, concat(replace(text, '[', ''), '。毕业需修满 ', {_CLAIMED}, ' 学分[1]。排名前', {_TOP}, '%[2]。') AS answer, {_CLAIMED} AS claimed, {_TRUE} AS fact, {_TOP} AS top, {_TRUE_TOP} AS fact_top, conv_id FROM {{conversations}} WHERE role = 'assistant'"
EVIDENCE = "SELECT query_id, 1 AS rank, concat('毕业要求：', fact, '学分。') AS text, '浙江工业大学学生管理办法.pdf' AS source_file, '第三章' AS heading_path, '' AS chapter, 'structured' AS chunk_strategy FROM a UNION ALL SELECT query_id, 2, concat('排名前', fact_top, '%者可申请，第六条。'), '关于评优的通知.pdf', '', '', 'structured' FROM a WHERE conv_id % 3 <> 0"
# Whether the credits, and the rank with the condition that it is, have support.
CHECKED = "checked AS (SELECT *, claimed = fact AS credits_ok, conv_id % 3 <> 0 AND top = fact_top AS rank_ok, CAST(CASE WHEN claimed = fact THEN 0 ELSE 1 END + CASE WHEN conv_id % 3 <> 0 AND top = fact_top THEN 0 ELSE 2 END AS INT) AS bad FROM a)"


def answers(spark, sf_dir):
    return view(spark, sf_dir, ANSWERS)


def evidence(spark, sf_dir):
    return spark.sql(EVIDENCE.replace("FROM a", "FROM {a}"), a=answers(spark, sf_dir))


_A = f"WITH a AS ({ANSWERS}), e AS ({EVIDENCE}) "
_C = f"WITH a AS ({ANSWERS}), e AS ({EVIDENCE}), {CHECKED} "


@query(_A + "SELECT query_id, rank AS index, CASE rank WHEN 1 THEN '浙江工业大学学生管理办法' ELSE '关于评优的通知' END AS doc_title, CASE rank WHEN 2 THEN '第六条' ELSE '' END AS article, '' AS chapter FROM e")
def citation_sources(spark, sf_dir):
    return ground.citation_sources(evidence(spark, sf_dir)).select("query_id", "index", "doc_title", "article", "chapter")


_CONTEXT = "SELECT query_id, string_agg(concat('[', CAST(rank AS STRING), '] 来源：《', CASE rank WHEN 1 THEN '浙江工业大学学生管理办法》' ELSE '关于评优的通知》 第六条' END, chr(10), text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context FROM e GROUP BY query_id"


@query(_A + _CONTEXT)
def contexts(spark, sf_dir):
    return ground.build_context(answers(spark, sf_dir).select("query_id"), ground.citation_sources(evidence(spark, sf_dir)))


@query(_A + "SELECT query_id, rank AS index, CASE rank WHEN 1 THEN '依据《浙江工业大学学生管理办法》[1]' ELSE '依据《关于评优的通知》第六条[2]' END AS citation FROM e")
def resolved_citations(spark, sf_dir):
    found = ground.resolve_citations(answers(spark, sf_dir), ground.citation_sources(evidence(spark, sf_dir)))
    return ground.format_citation(found).select("query_id", "index", "citation")


def _filled(template: str) -> str:
    """The template as a SQL expression over context and query."""
    quoted = template.replace("\n", "' || chr(10) || '")
    return "'" + quoted.replace("{context}", "' || context || '").replace("{question}", "' || query || '") + "'"


@query(_A + f", c AS ({_CONTEXT}) SELECT a.query_id, {_filled(ground.CONSTRAINED)} AS constrained, {_filled(ground.NAIVE)} AS naive FROM a JOIN c ON a.query_id = c.query_id")
def prompts(spark, sf_dir):
    a = answers(spark, sf_dir).select("query_id", "query")
    c = ground.build_context(a, ground.citation_sources(evidence(spark, sf_dir)))
    both = ground.build_prompts(ground.build_prompts(c).withColumnRenamed("prompt", "constrained"), ground.NAIVE)
    return both.select("query_id", "constrained", F.col("prompt").alias("naive"))


@query(_A + "SELECT query_id, CASE WHEN conv_id % 7 = 0 THEN '召回为空' WHEN conv_id % 9 = 0 THEN '超范围问题（命中关键词：转专业）' END AS reason, conv_id % 7 = 0 OR conv_id % 9 = 0 AS should_fallback FROM a")
def pre_fallbacks(spark, sf_dir):
    a = answers(spark, sf_dir)
    counts = a.where("conv_id % 7 <> 0").select("query_id", F.lit(2).alias("n"))
    return ground.pre_fallback(a, counts).select("query_id", "reason", "should_fallback")


def _verified(spark, sf_dir):
    return ground.verify(answers(spark, sf_dir), evidence(spark, sf_dir))


@query(_C + "SELECT query_id, 3 AS total_claims, bad AS hallucination_count FROM checked")
def verified_answers(spark, sf_dir):
    """Three claims an answer: its credits, its rank, and the rank as a condition."""
    return _verified(spark, sf_dir).select("query_id", "total_claims", "hallucination_count")


def _item(ok: str, kind: str, claim: str) -> str:
    return f"CASE WHEN {ok} THEN [] ELSE ['  - [{kind}] \"' || {claim} || '\"', '    状态：原文中未找到支撑'] END"


def _good(ok: str, kind: str, claim: str) -> str:
    return f"CASE WHEN {ok} THEN ['  + [{kind}] \"' || {claim} || '\" '] ELSE [] END"


_CLAIMS = [("credits_ok", "value", "claimed || '学分'"), ("rank_ok", "value", "'前' || top || '%'"), ("rank_ok", "condition", "'排名前' || top || '%'")]
_ITEMS, _GOOD = (f"list_concat({f(*_CLAIMS[0])}, list_concat({f(*_CLAIMS[1])}, {f(*_CLAIMS[2])}))" for f in (_item, _good))


@query(_C + f"""SELECT query_id, bad / 3.0 AS rate, array_to_string(list_concat(['校验' || CASE bad WHEN 0 THEN '通过' ELSE '发现 ' || CAST(bad AS STRING) || ' 条疑似幻觉' END || '：共 3 条声明，幻觉率 ' || format('{{:.1f}}', bad * 100 / 3.0) || '%', ''],
CASE WHEN bad = 0 THEN ['所有声明均在原文中找到支撑。'] ELSE list_concat(['疑似幻觉项：'], list_concat({_ITEMS}, CASE WHEN bad < 3 THEN list_concat(['', '已验证项：'], {_GOOD}) ELSE [] END)) END), chr(10)) AS report FROM checked""")
def verification_reports(spark, sf_dir):
    return ground.format_report(_verified(spark, sf_dir)).select("query_id", "rate", "report")


_DUE = "conv_id % 9 = 0 OR bad = 3"


@query(_C + f"SELECT query_id, CASE WHEN conv_id % 9 = 0 THEN '超范围问题（命中关键词：转专业）' WHEN bad = 3 THEN '校验失败（幻觉率 100%）' END AS reason, CASE WHEN {_DUE} THEN '{FALLBACK_ANSWER}' ELSE answer END AS answer, CASE WHEN {_DUE} THEN 0 ELSE 2 END AS citations, {_DUE} AS should_fallback FROM checked")
def post_fallbacks(spark, sf_dir):
    v = _verified(spark, sf_dir).withColumns({"n": F.lit(2), "citations": F.array(F.lit(1), F.lit(2))})
    return ground.post_fallback(v).select("query_id", "reason", "answer", F.size("citations").alias("citations"), "should_fallback")


@query(_A + "SELECT query_id, 'credit' AS type, claimed || '学分' AS value FROM a UNION ALL SELECT query_id, 'percent_rank', '前' || top || '%' FROM a")
def extracted_values(spark, sf_dir):
    return ground.extract_values(answers(spark, sf_dir), "query_id", "answer")


@query(_A + "SELECT query_id, clause_no, condition FROM (SELECT query_id, 1 AS clause_no, '排名前' || top || '%' AS condition FROM a)")
def extracted_conditions(spark, sf_dir):
    """Conditions of the whole answers, by the number of their clause among those with conditions."""
    c = ground.extract_conditions(ground.clauses(ground.sentences(answers(spark, sf_dir).select("query_id", "answer"), "answer"))).where(F.size("conditions") > 0)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("sentence_no", "clause_no"))
    return c.withColumn("clause_no", nth).select("query_id", "clause_no", F.explode("conditions").alias("condition"))


# Plans by year and major; those of even ids of one major agree on a total, others state several.
PLANS = "SELECT concat(CAST(2020 + doc_id % 2 AS STRING), CASE doc_id % 3 WHEN 0 THEN '软件工程' ELSE '网络工程' END, '专业培养计划.pdf') AS source_file, concat(text, ' 毕业学分要求：', CASE doc_id % 3 WHEN 0 THEN '165.5' ELSE CAST(160 + length(text) % 2 AS STRING) END, ' 学分') AS text, CAST(2020 + doc_id % 2 AS STRING) AS plan_year, CASE doc_id % 3 WHEN 0 THEN '软件工程' ELSE '网络工程' END AS major, CASE doc_id % 3 WHEN 0 THEN '165.5' ELSE CAST(160 + length(text) % 2 AS STRING) END AS stated FROM {documents}"
_ASKED = "SELECT conv_id * 1000 + turn AS query_id, CASE length(text) % 4 WHEN 0 THEN '2020' WHEN 1 THEN '2021' WHEN 2 THEN '2019' ELSE '' END AS asked_year, CASE length(text) % 3 WHEN 0 THEN '软件工程' WHEN 1 THEN '网络工程' ELSE '数字媒体技术' END AS asked_major, text FROM {conversations}"
TOTALS = f"SELECT query_id, CASE WHEN length(text) % 5 = 0 THEN text ELSE concat(CASE asked_year WHEN '' THEN '' ELSE concat(asked_year, '级') END, asked_major, '专业毕业需要多少学分？') END AS query, asked_year, asked_major, length(text) % 5 <> 0 AS asks FROM ({_ASKED}) x"


@query(f"WITH p AS ({PLANS}), q AS ({TOTALS}), f AS (SELECT major, plan_year, count(DISTINCT stated) AS totals, min(stated) AS total FROM p GROUP BY major, plan_year), m AS (SELECT query_id, count(*) FILTER (asked_year = '' OR asked_year = plan_year) AS files, max(totals) FILTER (asked_year = '' OR asked_year = plan_year) AS totals, max(total) FILTER (asked_year = '' OR asked_year = plan_year) AS total FROM q JOIN f ON asks AND asked_major = major GROUP BY query_id) SELECT query_id, CASE WHEN files = 1 AND totals = 1 THEN total END AS total, CASE WHEN files = 1 AND totals = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM m")
def total_credits(spark, sf_dir):
    """Questions for the total credits of a major, with a year or without, against plans made of all documents."""
    return ground.lookup_totals(view(spark, sf_dir, TOTALS), view(spark, sf_dir, PLANS))


SCORED = "SELECT conv_id * 1000 + turn AS query_id, conv_id % 10 = 0 AS negative_sample, conv_id % 20 = 0 AS rejected, turn % 2 = 0 AS is_table_question, conv_id % 3 + 1 AS n_values, conv_id % 2 AS values_hit, 2 AS n_conditions, turn % 3 AS conditions_hit, conv_id % 4 AS unsupported, role FROM {conversations}"
_P = "FILTER (NOT negative_sample)"


@query(f"SELECT role, count(*) AS answers, round(coalesce(sum(values_hit) {_P} / nullif(sum(n_values) {_P}, 0), 0), 4) AS value_accuracy, round(coalesce(sum(conditions_hit) {_P} / nullif(sum(n_conditions) {_P}, 0), 0), 4) AS condition_coverage, round(coalesce((sum(n_values - values_hit + n_conditions - conditions_hit + unsupported) {_P}) / nullif(sum(n_values + n_conditions) {_P}, 0), 0), 4) AS combined_rate, round(coalesce(count(*) FILTER (negative_sample AND rejected) / nullif(count(*) FILTER (negative_sample), 0), 0), 4) AS negative_rejection, round(coalesce(sum(values_hit) FILTER (NOT negative_sample AND is_table_question) / nullif(sum(n_values) FILTER (NOT negative_sample AND is_table_question), 0), 0), 4) AS table_value_accuracy FROM ({SCORED}) GROUP BY role")
def hallucination_summary(spark, sf_dir):
    return evaluate.hallucination_summary(view(spark, sf_dir, SCORED), ("role",))


@query(f"SELECT query_id, CAST(issues AS BIGINT) AS issues FROM (SELECT query_id, n_values - values_hit + n_conditions - conditions_hit + unsupported AS issues FROM ({SCORED}) ORDER BY issues DESC, query_id LIMIT 10) WHERE issues > 0")
def worst_answers(spark, sf_dir):
    return evaluate.worst_answers(view(spark, sf_dir, SCORED)).withColumn("issues", F.col("issues").cast("bigint"))


@query(f"SELECT query_id FROM ({SCORED}) WHERE NOT negative_sample ORDER BY md5(concat(CAST(query_id AS STRING), ':42')), query_id LIMIT 20")
def sampled_questions(spark, sf_dir):
    return evaluate.sample_questions(view(spark, sf_dir, SCORED), 20).select("query_id")


@query(_A + "SELECT query_id, CASE WHEN claimed = fact THEN 1 ELSE 0 END AS values_hit, CASE WHEN top = fact_top THEN 1 ELSE 0 END AS conditions_hit FROM a")
def scored_answers(spark, sf_dir):
    a = answers(spark, sf_dir).withColumns({"expected_values": F.array(F.concat("fact", F.lit("学分")), F.lit("999元")), "expected_conditions": F.array(F.concat(F.lit("前"), "fact_top", F.lit("%")), F.lit("不及格"))})
    return evaluate.score_answers(a).select("query_id", "values_hit", "conditions_hit")


@query(_A + "SELECT a.query_id, query AS question, array_to_string(list(text ORDER BY rank), '|') AS contexts FROM a JOIN e ON a.query_id = e.query_id GROUP BY a.query_id, query")
def qa_table(spark, sf_dir):
    a = answers(spark, sf_dir)
    t = evaluate.qa_eval_table(a.select("query_id", "query", F.lit("").alias("ground_truth")), a.select("query_id", "answer"), evidence(spark, sf_dir))
    return t.select("query_id", "question", F.array_join("contexts", "|").alias("contexts"))
