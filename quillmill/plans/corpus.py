"""Cleaning, structure, metadata, chunking and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, meta, structure
from ..operators import chunk, ground, stores, versions
from ..sources import io
from ..sources.shared import new_path, spread
from .registry import query, table, view

# Views: texts with what the operators look for, made alike in both engines.
NL = "chr(10)"
DIRTY = f"SELECT doc_id, concat('Page ', CAST(doc_id AS STRING), ' of many', {NL}, '- 3 -', {NL}, '​\u0007', replace(text, ' and ', '  and  '), '   ', chr(13), {NL}, '4 / 9', {NL}, {NL}, {NL}, {NL}, {NL}, '|  a  |  b  |', {NL}, 'x  y') AS text FROM {{documents}}"
STRUCTURED = f"SELECT doc_id, concat('preface', {NL}, '第一章 总则', {NL}, replace(text, '. ', concat('.', {NL})), {NL}, 'a = f(b);', {NL}, 'c = g(d);', {NL}, 'e = h(f);', {NL}, 'plain', {NL}, 'x = 1;', {NL}, '| h | k |', {NL}, '| - | - |', {NL}, '一、范围', {NL}, '1.1、适用', {NL}, '2. this sentence ends。') AS text FROM {{documents}}"
NAMED = "SELECT doc_id, text, CASE doc_id % 8 WHEN 0 THEN '3 关于2024-2025学年第一学期选课的通知.pdf' WHEN 1 THEN '浙江工业大学学生管理办法.docx' WHEN 2 THEN '2023软件工程专业培养计划.pdf' WHEN 3 THEN '计算机学院名额分布.pdf' WHEN 4 THEN '屏峰校区缓考说明.txt' WHEN 5 THEN '2022年工作.md' WHEN 6 THEN '7 浙工大发〔2022〕46号浙江工业大学奖学金评定办法.pdf' ELSE 'plain.txt' END AS source_file, concat(CASE doc_id % 5 WHEN 0 THEN '培养目标 2021-2022学年第二学期 ' WHEN 1 THEN '特此通知 2024年3月5日 补考 补考 学籍 ' WHEN 2 THEN '浙江工业大学 2020/1/2 第三章 总则 第六条 ' WHEN 3 THEN '第二节 转专业 ' ELSE '' END, text) AS body FROM {documents}"
YEARLY = "SELECT doc_id AS ordinal, doc_id, text, source AS source_file, lang AS business_tag, CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(CAST(2020 + doc_id % 4 AS STRING), '-', CAST(2021 + doc_id % 4 AS STRING)) END AS academic_year FROM {documents}"

DROPPED = "(?i)^(Page\\s*\\d+.*|-\\s*\\d+\\s*-|\\d+\\s*/\\s*\\d+)$"
CLEANED = f"""WITH d AS ({DIRTY}), g AS (SELECT doc_id, regexp_replace(text, '[​\u0007]', '', 'g') AS t FROM d),
p AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(trim(x, ' ' || chr(9) || chr(13)), '{DROPPED}')), chr(10)) AS t FROM g),
w AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(t, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: rtrim(x, ' ' || chr(9))), chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS t FROM p)
SELECT doc_id, trim(array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN starts_with(trim(x), '|') THEN x ELSE regexp_replace(x, '[ \\t]{{2,}}', ' ', 'g') END), chr(10)), ' ' || chr(10)) AS text FROM w"""


@query(CLEANED.replace("{{", "{").replace("}}", "}"))
def cleaned_text(spark, sf_dir):
    return spread(view(spark, sf_dir, DIRTY)).select("doc_id", clean.clean_text(F.col("text")).alias("text"))


@query(f"""WITH d AS (SELECT doc_id, regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]|\\p{{{{Cf}}}}|\\p{{{{Co}}}}', '', 'g') AS t FROM ({DIRTY})),
n AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{{{{3,}}}}', chr(10) || chr(10), 'g') AS t FROM d)
SELECT doc_id, left(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), 2000) AS text FROM n""".replace("{{", "{").replace("}}", "}"))
def sanitized_text(spark, sf_dir):
    return view(spark, sf_dir, DIRTY).select("doc_id", clean.sanitize_text(F.col("text")).alias("text"))


@query("SELECT event_id, concat(CAST(event_id AS STRING), '.5%') AS value FROM events")
def normalized_values(spark, sf_dir):
    wide = F.translate(F.col("event_id").cast("string"), "0123456789", "０１２３４５６７８９")
    return table(spark, sf_dir, "events").select("event_id", clean.normalize_value(F.concat(wide, F.lit(" ．５ ％\t"))).alias("value"))


@query(f"""WITH d AS ({STRUCTURED}), l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
f AS (SELECT doc_id, ls, list_transform(ls, lambda x: regexp_matches(x, '[{{}}();=<>]') AND trim(x) <> '') AS c FROM l),
m AS (SELECT doc_id, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: concat(
CASE WHEN c[i] AND coalesce(c[i + 1], false) AND coalesce(c[i + 2], false) AND NOT coalesce(CASE WHEN i > 1 THEN c[i - 1] END, false) THEN '```' || chr(10) ELSE '' END, ls[i],
CASE WHEN i > 2 AND c[i] AND c[i - 1] AND c[i - 2] AND NOT coalesce(c[i + 1], false) THEN chr(10) || '```' ELSE '' END)), chr(10)) AS text FROM f)
SELECT doc_id, text FROM m""".replace("{{}}", "{}"))
def code_marked(spark, sf_dir):
    return view(spark, sf_dir, STRUCTURED).select("doc_id", structure.mark_code_blocks(F.col("text")).alias("text"))


@query(f"""WITH d AS ({STRUCTURED}), l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
f AS (SELECT doc_id, ls, list_transform(ls, lambda x: starts_with(trim(x), '|') AND ends_with(trim(x), '|')) AS t FROM l)
SELECT doc_id, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: concat(CASE WHEN t[i] <> (CASE WHEN i > 1 THEN t[i - 1] ELSE false END) THEN chr(10) ELSE '' END, CASE WHEN t[i] THEN trim(ls[i]) ELSE ls[i] END)), chr(10)) AS text FROM f""")
def tables_normalized(spark, sf_dir):
    return view(spark, sf_dir, STRUCTURED).select("doc_id", structure.normalize_tables(F.col("text")).alias("text"))


@query(f"""WITH d AS ({STRUCTURED}) SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE
WHEN regexp_matches(trim(x), '^第[一二三四五六七八九十]+[章节].+$') AND length(regexp_replace(trim(x), '^第[一二三四五六七八九十]+[章节]\\s*', '')) BETWEEN 1 AND 40 AND NOT regexp_matches(x, '[。；！？]') THEN '## ' || trim(x)
WHEN regexp_matches(trim(x), '^[一二三四五六七八九十]+、.+$') AND length(trim(x)) <= 40 AND NOT regexp_matches(x, '[。；！？]') THEN '### ' || trim(x)
WHEN regexp_matches(trim(x), '^\\d+(\\.\\d+)*[、.]\\s*.+$') AND length(regexp_replace(trim(x), '^\\d+(\\.\\d+)*[、.]\\s*', '')) BETWEEN 1 AND 40 AND NOT regexp_matches(x, '[。；！？]') THEN '#### ' || trim(x) ELSE x END), chr(10)) AS text FROM d""")
def headings_normalized(spark, sf_dir):
    return view(spark, sf_dir, STRUCTURED).select("doc_id", structure.normalize_headings(F.col("text")).alias("text"))


def _case(col: str, rules) -> str:
    return " ".join("WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules)


from ..functions import rules as R  # noqa: E402

_RANGE = "(\\d{4})[-—](\\d{4})"
_SEM = "(\\d{4})[-—](\\d{4})学年.*?第([一二])学期"


def _range_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{_RANGE}') THEN regexp_extract({c}, '{_RANGE}', 1) || '-' || regexp_extract({c}, '{_RANGE}', 2) END"


def _sem_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{_SEM}') THEN regexp_extract({c}, '{_SEM}', 1) || '-' || regexp_extract({c}, '{_SEM}', 2) || '-' || regexp_extract({c}, '{_SEM}', 3) END"


def _year_sql(c: str) -> str:
    return ", ".join([_range_sql(c), *[f"nullif(regexp_extract({c}, '{p}', 1), '')" for p in ("(\\d{4})\\s*年", "(\\d{4})级", "(\\d{4})")]])


_COUNTS = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS t, {i} AS o, " + " + ".join(f"(length(left(body, 2000)) - length(replace(left(body, 2000), '{w}', ''))) // {len(w)}" for w in ws) + " AS n FROM d" for i, (t, ws) in enumerate(R.TAGS))


@query(f"""WITH d AS (SELECT *, regexp_replace(source_file, '\\.[^.]*$', '') AS stem FROM ({NAMED})), n AS ({_COUNTS}), best AS (SELECT doc_id, arg_max(t, n * 100 - o) FILTER (n > 0) AS t FROM n GROUP BY doc_id)
SELECT d.doc_id, lower(regexp_extract(source_file, '\\.[^.]+$')) AS file_type,
CASE {_case('stem', R.TAGS)} ELSE CASE {_case('left(body, 2000)', R.MARKERS)} ELSE coalesce(best.t, '其他') END END AS business_tag,
coalesce({_year_sql('stem')}, {_year_sql('left(body, 500)')}, '') AS academic_year,
CASE {_case('stem', R.TYPE_BY_NAME)} ELSE CASE {_case('left(body, 2000)', R.TYPE_BY_TEXT)} ELSE '制度' END END AS doc_type,
coalesce({_sem_sql('stem')}, {_range_sql('stem')}, nullif(regexp_extract(stem, '(\\d{{4}})年', 1), ''), {_sem_sql('left(body, 500)')}, {_range_sql('left(body, 500)')}, '') AS effective_date,
CASE {_case('stem', R.SCOPE_BY_NAME)} ELSE CASE {_case('left(body, 1000)', R.SCOPE_BY_TEXT)} ELSE '' END END AS scope,
CASE WHEN regexp_matches(left(body, 1000), '(\\d{{4}})年(\\d{{1,2}})月(\\d{{1,2}})日') THEN regexp_extract(left(body, 1000), '(\\d{{4}})年', 1) || '-' || lpad(regexp_extract(left(body, 1000), '年(\\d{{1,2}})月', 1), 2, '0') || '-' || lpad(regexp_extract(left(body, 1000), '月(\\d{{1,2}})日', 1), 2, '0')
WHEN regexp_matches(left(body, 1000), '(\\d{{4}})[-/](\\d{{1,2}})[-/](\\d{{1,2}})') THEN regexp_extract(left(body, 1000), '(\\d{{4}})[-/](\\d{{1,2}})[-/](\\d{{1,2}})', 1) || '-' || lpad(regexp_extract(left(body, 1000), '(\\d{{4}})[-/](\\d{{1,2}})[-/](\\d{{1,2}})', 2), 2, '0') || '-' || lpad(regexp_extract(left(body, 1000), '(\\d{{4}})[-/](\\d{{1,2}})[-/](\\d{{1,2}})', 3), 2, '0') END AS update_time
FROM d LEFT JOIN best ON d.doc_id = best.doc_id""")
def document_metadata(spark, sf_dir):
    m = meta.extract_metadata(view(spark, sf_dir, NAMED), body="body")
    return m.select("doc_id", "file_type", "business_tag", "academic_year", "doc_type", "effective_date", "scope", "update_time")


@query(f"""WITH d AS ({NAMED}) SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '关于2024-2025学年第一学期选课的通知' WHEN 1 THEN '浙江工业大学学生管理办法' WHEN 2 THEN '软件工程专业培养计划' WHEN 3 THEN '计算机学院名额分布' WHEN 4 THEN '屏峰校区缓考说明' WHEN 5 THEN '年工作.md' WHEN 6 THEN '浙江工业大学奖学金评定办法' ELSE 'plain' END AS title,
CASE doc_id % 5 WHEN 2 THEN '第六条' WHEN 3 THEN '第二节' ELSE '' END AS article, CASE doc_id % 5 WHEN 2 THEN '第三章 总则' ELSE '' END AS chapter FROM d""")
def titles_and_marks(spark, sf_dir):
    return view(spark, sf_dir, NAMED).select("doc_id", meta.doc_title(F.col("source_file")).alias("title"), meta.article_mark(F.col("body")).alias("article"), meta.chapter_mark(F.col("body")).alias("chapter"))


# Replies of a model made of whole texts: numbered, marked lines, and an empty one between each two.
REPLIES = f"SELECT conv_id, turn, text, concat('1. **', replace(text, {NL}, concat('**', {NL}, {NL}, '2、`')), '`') AS reply FROM {{conversations}}"


@query(f"""WITH r AS ({REPLIES}), l AS (SELECT conv_id, turn, text, unnest(string_split(trim(reply, ' ' || chr(10)), chr(10))) AS line, unnest(range(len(string_split(trim(reply, ' ' || chr(10)), chr(10))))) AS no FROM r),
p AS (SELECT *, trim(regexp_replace(regexp_replace(trim(line), '^\\d+[.、)\\] ]+\\s*', ''), '^[*`]+|[*`]+$', '', 'g')) AS variant FROM l)
SELECT conv_id, turn, string_agg(variant, '|' ORDER BY no) AS variants, md5(any_value(text)) AS key FROM p WHERE variant <> '' GROUP BY conv_id, turn""")
def parsed_rewrites(spark, sf_dir):
    r = view(spark, sf_dir, REPLIES)
    return r.select("conv_id", "turn", F.array_join(meta.parse_rewrites(F.col("reply")), "|").alias("variants"), meta.query_key(F.col("text")).alias("key"))


@query("SELECT doc_id, i AS piece, substr(text, i * 450 + 1, 500) AS content FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 500) / 450.0), 0) AS BIGINT) + 1)) AS i FROM documents) WHERE trim(substr(text, i * 450 + 1, 500), ' ' || chr(10)) <> ''")
def hard_splits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.hard_split(F.col("text"))).alias("piece", "content")).withColumn("piece", F.col("piece").cast("bigint"))


SECTIONED = f"SELECT doc_id, concat('# A', CAST(doc_id % 7 AS STRING), {NL}, replace(text, {NL}, concat({NL}, '## B', {NL}))) AS text FROM {{documents}}"


@query(f"""WITH d AS ({SECTIONED}), l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d), e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM l),
s AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS sec FROM e),
b AS (SELECT doc_id, sec, trim(string_agg(line, chr(10) ORDER BY no) FILTER (NOT starts_with(line, '#')), ' ' || chr(10)) AS body FROM s GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section, CASE WHEN sec = 1 THEN 'A' || CAST(doc_id % 7 AS STRING) ELSE 'A' || CAST(doc_id % 7 AS STRING) || ' > B' END AS path, body FROM b WHERE body <> ''""")
def sections_by_heading(spark, sf_dir):
    s = chunk.split_sections(view(spark, sf_dir, SECTIONED), key="doc_id")
    return s.select("doc_id", F.col("section").cast("bigint").alias("section"), F.array_join("heading_path", " > ").alias("path"), "body")


HEADED = f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat('#tag no heading', {NL}, replace(text, {NL}, concat({NL}, '##  '))) ELSE concat(text, {NL}, '### Last ', CAST(doc_id AS STRING), '  ', {NL}, '# Later') END AS text FROM {{documents}}"


@query(f"SELECT doc_id, trim(regexp_extract(text, '(?m)^#+\\s+(.+)$', 1)) AS chapter FROM ({HEADED})")
def first_headings(spark, sf_dir):
    return view(spark, sf_dir, HEADED).select("doc_id", meta.chapter(F.col("text")).alias("chapter"))


# Documents with sections, paragraphs, code between fences, and tables; some paragraphs and tables are long.
_BETWEEN = f"CASE doc_id % 4 WHEN 0 THEN concat({NL}, {NL}) WHEN 1 THEN concat({NL}, '```py', {NL}, 'code = 1', {NL}, {NL}, '```', {NL}) WHEN 2 THEN concat(' |', {NL}, '| ') ELSE concat({NL}, '## B', {NL}) END"
_SENTENCES = f"CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', concat('.', {NL}, {NL}, ' ')) ELSE text END"
BLOCKY = f"SELECT doc_id, concat('# T', CAST(doc_id % 7 AS STRING), {NL}, CASE WHEN doc_id % 4 = 2 THEN concat('| h | k |', {NL}, '| --- | --- |', {NL}, '| ') ELSE '' END, replace({_SENTENCES}, {NL}, {_BETWEEN}), CASE WHEN doc_id % 4 = 2 THEN ' |' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN concat({NL}, '```', {NL}, 'open') ELSE '' END) AS text FROM {{documents}}"

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
# The text's lines as blocks: a table line closes code, a closing fence ends its block, and what is open ends with the text.
_BLOCKS = f"""line AS (SELECT doc_id, section, path, level, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS i FROM bodies),
flagged AS (SELECT *, starts_with(s, '|') AND ends_with(s, '|') AS tab, starts_with(s, '```') AS fence FROM (SELECT *, {_STRIP.format('line')} AS s FROM line)),
grouped AS (SELECT *, count(*) FILTER (tab) OVER (PARTITION BY doc_id, section ORDER BY i) AS tables FROM flagged),
fenced AS (SELECT *, count(*) FILTER (fence) OVER (PARTITION BY doc_id, section, tables ORDER BY i) % 2 = 1 AS inside FROM grouped),
kinds AS (SELECT *, CASE WHEN tab THEN 'table' WHEN fence OR inside THEN 'code' ELSE 'text' END AS kind, fence AND NOT inside AS closing FROM fenced),
turns AS (SELECT *, i = 0 OR kind <> lag(kind) OVER w OR lag(closing) OVER w AS turn FROM kinds WINDOW w AS (PARTITION BY doc_id, section ORDER BY i)),
numbered AS (SELECT *, count(*) FILTER (turn) OVER (PARTITION BY doc_id, section ORDER BY i) - 1 AS block FROM turns),
block AS (SELECT doc_id, section, path, level, block, any_value(kind) AS kind, string_agg(line, chr(10) ORDER BY i) AS content, list(line ORDER BY i) AS lines FROM numbered GROUP BY doc_id, section, path, level, block)"""
_WINDOWS = "list_filter(list_transform(range(CAST(greatest(ceil((length({0}) - 500) / 450.0), 0) AS BIGINT) + 1), lambda k: substr({0}, k * 450 + 1, 500)), lambda x: " + _STRIP.format("x") + " <> '')"
# Paragraphs join up to 500 characters, each pack after the last 50 of the one before; rows of long tables up to what the two
# header lines leave.
_PIECES = f"""part AS (SELECT *, list_filter(list_transform(string_split_regex(content, '\n\n+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS parts FROM block),
packed AS (SELECT *, list_reduce(list_transform(parts, lambda x: {{'p': x, 'out': CAST([] AS VARCHAR[]), 'cur': '', 'used': CAST(0 AS BIGINT)}}),
  lambda a, b: CASE WHEN length(b.p) > 500 THEN {{'p': '', 'out': a.out || CASE WHEN a.cur = '' THEN [] ELSE [a.cur] END || {_WINDOWS.format('b.p')}, 'cur': '', 'used': CAST(0 AS BIGINT)}}
    WHEN a.cur = '' THEN {{'p': '', 'out': a.out, 'cur': b.p, 'used': CAST(length(b.p) AS BIGINT)}}
    WHEN a.used + length(b.p) <= 500 THEN {{'p': '', 'out': a.out, 'cur': concat(a.cur, chr(10), chr(10), b.p), 'used': a.used + length(b.p)}}
    ELSE {{'p': '', 'out': a.out || [a.cur], 'cur': concat({_STRIP.format('right(a.cur, 50)')}, chr(10), chr(10), b.p), 'used': CAST(length({_STRIP.format('right(a.cur, 50)')}) + length(b.p) AS BIGINT)}} END,
  {{'p': '', 'out': CAST([] AS VARCHAR[]), 'cur': '', 'used': CAST(0 AS BIGINT)}}) AS r,
  list_reduce(list_transform(lines[3:], lambda x: {{'p': x, 'out': CAST([] AS VARCHAR[]), 'cur': CAST(NULL AS VARCHAR), 'used': CAST(0 AS BIGINT)}}),
  lambda a, b: CASE WHEN a.cur IS NULL THEN {{'p': '', 'out': a.out, 'cur': b.p, 'used': CAST(length(b.p) AS BIGINT)}}
    WHEN a.used + length(b.p) <= 500 - length(lines[1]) - length(lines[2]) THEN {{'p': '', 'out': a.out, 'cur': concat(a.cur, chr(10), b.p), 'used': a.used + length(b.p)}}
    ELSE {{'p': '', 'out': a.out || [a.cur], 'cur': b.p, 'used': CAST(length(b.p) AS BIGINT)}} END,
  {{'p': '', 'out': CAST([] AS VARCHAR[]), 'cur': CAST(NULL AS VARCHAR), 'used': CAST(0 AS BIGINT)}}) AS t FROM part),
cut AS (SELECT *, CASE WHEN kind = 'code' OR kind = 'table' AND (length(content) <= 1000 OR len(lines) <= 2) THEN [content]
  WHEN kind = 'table' THEN list_transform(t.out || [t.cur], lambda x: concat(lines[1], chr(10), lines[2], chr(10), x)) ELSE r.out || CASE WHEN r.cur = '' THEN [] ELSE [r.cur] END END AS pieces FROM packed),
piece AS (SELECT doc_id, section, block, kind, path, level, unnest(range(len(pieces))) AS piece, unnest(pieces) AS content, CASE WHEN kind = 'table' AND contains(string_split({_STRIP.format('content')}, chr(10))[1], '|') THEN array_to_string(list_filter(list_transform(string_split(string_split({_STRIP.format('content')}, chr(10))[1], '|'), lambda x: trim(x)), lambda x: x NOT IN ('', '---')), ',') END AS columns FROM cut)
SELECT doc_id, section, block, piece, row_number() OVER (PARTITION BY doc_id ORDER BY section, block, piece) - 1 AS chunk_index, kind AS content_type, path AS heading_path, level AS heading_level, concat(CASE WHEN path = '' THEN '' ELSE concat(path, chr(10), chr(10)) END, content) AS content, columns FROM piece"""
_BODIES = f"""WITH d AS ({BLOCKY}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM d),
s AS (SELECT *, count(*) FILTER (starts_with(line, '#')) OVER (PARTITION BY doc_id ORDER BY no) AS sec FROM l),
b AS (SELECT doc_id, sec, {_STRIP.format("string_agg(line, chr(10) ORDER BY no) FILTER (NOT starts_with(line, '#'))")} AS body FROM s GROUP BY ALL),
bodies AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section, concat('T', CAST(doc_id % 7 AS STRING), CASE WHEN sec > 1 THEN ' > B' ELSE '' END) AS path, CASE WHEN sec > 1 THEN 2 ELSE 1 END AS level, body FROM b WHERE body <> ''),
"""


def _chunk_rows(spark, sf_dir, strategy: str):
    c = chunk.chunk(view(spark, sf_dir, BLOCKY), key="doc_id", strategy=strategy)
    whole = ("section", "block", "piece", "chunk_index", "heading_level")
    return c.select("doc_id", "content_type", "heading_path", "content", F.array_join("table_columns", ",").alias("columns"), *[F.col(n).cast("bigint").alias(n) for n in whole])


@query(_BODIES + _BLOCKS + ", " + _PIECES)
def document_chunks(spark, sf_dir):
    """Sections, their blocks, packed paragraphs and split tables of whole documents."""
    return _chunk_rows(spark, sf_dir, "structured")


@query(f"WITH bodies AS (SELECT doc_id, 0 AS section, '' AS path, 0 AS level, text AS body FROM ({BLOCKY})), " + _BLOCKS + ", " + _PIECES)
def recursive_chunks(spark, sf_dir):
    """The same documents without sections."""
    return _chunk_rows(spark, sf_dir, "recursive")


# The whole way from a view (doc_id, text) to chunks: cleaned, code, tables and headings marked, sections by a stack of headings.
_MARKED = """raw AS ({0}), kept AS (SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), chr(10)), lambda x: NOT regexp_matches(trim(x, ' ' || chr(9) || chr(13)), '""" + DROPPED + """')), chr(10)) AS t FROM raw),
tidy AS (SELECT doc_id, string_split(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(t, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: rtrim(x, ' ' || chr(9))), chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), chr(10)) AS ls FROM kept),
clean AS (SELECT doc_id, string_split(trim(array_to_string(list_transform(ls, lambda x: CASE WHEN starts_with(trim(x), '|') THEN x ELSE regexp_replace(x, '[ \\t]{{2,}}', ' ', 'g') END), chr(10)), ' ' || chr(10)), chr(10)) AS ls FROM tidy),
code AS (SELECT doc_id, ls, list_transform(ls, lambda x: regexp_matches(x, '[{{}}();=<>]') AND trim(x) <> '') AS c FROM clean),
coded AS (SELECT doc_id, string_split(array_to_string(list_transform(range(1, len(ls) + 1), lambda i: concat(CASE WHEN c[i] AND coalesce(c[i + 1], false) AND coalesce(c[i + 2], false) AND NOT coalesce(CASE WHEN i > 1 THEN c[i - 1] END, false) THEN '```' || chr(10) ELSE '' END, ls[i],
  CASE WHEN i > 2 AND c[i] AND c[i - 1] AND c[i - 2] AND NOT coalesce(c[i + 1], false) THEN chr(10) || '```' ELSE '' END)), chr(10)), chr(10)) AS ls FROM code),
tables AS (SELECT doc_id, ls, list_transform(ls, lambda x: starts_with(trim(x), '|') AND ends_with(trim(x), '|')) AS t FROM coded),
tabled AS (SELECT doc_id, string_split(array_to_string(list_transform(range(1, len(ls) + 1), lambda i: concat(CASE WHEN t[i] <> (CASE WHEN i > 1 THEN t[i - 1] ELSE false END) THEN chr(10) ELSE '' END, CASE WHEN t[i] THEN trim(ls[i]) ELSE ls[i] END)), chr(10)), chr(10)) AS ls FROM tables),
headed AS (SELECT doc_id, list_transform(ls, lambda x: CASE
  WHEN regexp_matches(trim(x), '^第[一二三四五六七八九十]+[章节].+$') AND length(regexp_replace(trim(x), '^第[一二三四五六七八九十]+[章节]\\s*', '')) BETWEEN 1 AND 40 AND NOT regexp_matches(x, '[。；！？]') THEN '## ' || trim(x)
  WHEN regexp_matches(trim(x), '^[一二三四五六七八九十]+、.+$') AND length(trim(x)) <= 40 AND NOT regexp_matches(x, '[。；！？]') THEN '### ' || trim(x)
  WHEN regexp_matches(trim(x), '^\\d+(\\.\\d+)*[、.]\\s*.+$') AND length(regexp_replace(trim(x), '^\\d+(\\.\\d+)*[、.]\\s*', '')) BETWEEN 1 AND 40 AND NOT regexp_matches(x, '[。；！？]') THEN '#### ' || trim(x) ELSE x END) AS ls FROM tabled),
l0 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM headed),
l1 AS (SELECT *, regexp_matches(trim(line), '^#{{1,6}}\\s+\\S') AS head FROM l0),
l2 AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY no) AS sec FROM l1),
heads AS (SELECT doc_id, list({{'level': length(regexp_extract(trim(line), '^#+')), 'title': trim(regexp_replace(trim(line), '^#+\\s+', ''))}} ORDER BY no) AS hs FROM l2 WHERE head GROUP BY doc_id),
secs AS (SELECT doc_id, sec, regexp_replace(string_agg(line, chr(10) ORDER BY no) FILTER (NOT head), '^\\s+|\\s+$', '', 'g') AS body FROM l2 GROUP BY ALL),
paths AS (SELECT s.doc_id, sec, body, list_reduce(list_transform(coalesce(hs, [])[1:sec], lambda h: {{'h': h, 'path': CAST([] AS STRUCT("level" BIGINT, title VARCHAR)[])}}), lambda a, b: {{'h': b.h, 'path': list_filter(a.path, lambda x: x.level < b.h.level) || [b.h]}}, {{'h': {{'level': CAST(0 AS BIGINT), 'title': ''}}, 'path': CAST([] AS STRUCT("level" BIGINT, title VARCHAR)[])}}).path AS stack FROM secs s LEFT JOIN heads h ON h.doc_id = s.doc_id WHERE body <> ''),
bodies AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section, array_to_string(list_transform(stack, lambda x: x.title), ' > ') AS path, len(stack) AS level, body FROM paths)"""


def _whole_chain_sql(source: str) -> str:
    return "WITH " + _MARKED.replace("{{", "{").replace("}}", "}").replace("{0}", source) + ", " + _BLOCKS + ", " + _PIECES


@query(f"SELECT doc_id, CAST(section AS INT) AS section, CAST(block AS INT) AS block, CAST(piece AS INT) AS piece, CAST(chunk_index AS INT) AS chunk_index, content_type, heading_path, CAST(heading_level AS INT) AS heading_level, content, 'structured' AS chunk_strategy FROM ({_whole_chain_sql(STRUCTURED)})")
def structured_chunks(spark, sf_dir):
    """Clean, mark and chunk the decorated documents."""
    d = structure.mark_structures(spread(view(spark, sf_dir, STRUCTURED)).withColumn("text", clean.clean_text(F.col("text"))))
    return chunk.chunk(d, key="doc_id").drop("table_columns")


@query()
def built_corpus(spark, sf_dir):
    """The named documents as a corpus: cleaned, marked, described and chunked, whole texts."""
    return chunk.build_corpus(spread(view(spark, sf_dir, NAMED)).drop("text"), text="body").drop("table_columns")


GRID = "SELECT o_orderkey AS k, o_orderstatus AS a, o_orderpriority AS b FROM {orders}"


@query("SELECT o_custkey, '| status | priority |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderstatus || ' | ' || o_orderpriority || ' |', chr(10) ORDER BY o_orderkey) AS markdown, 'status,priority' AS columns FROM orders GROUP BY o_custkey")
def markdown_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("c")))), lambda x: x["c"]).alias("rows"))
    md = structure.table_to_markdown(F.concat(F.array(F.array(F.lit("status"), F.lit("priority"))), F.col("rows")))
    out = rows.select("o_custkey", md.alias("markdown"))
    return out.withColumn("columns", F.array_join(chunk.table_columns(F.col("markdown")), ","))


@query("SELECT conv_id AS doc, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS total_pages FROM conversations GROUP BY conv_id")
def assembled_pages(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.lit(0).alias("part"), "text", F.lit(False).alias("from_image"))
    return io.assemble_pages(p).select("doc", "text", "total_pages")


TITLE = """regexp_replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&quot;', '"'), '&amp;?', '&', 'g') AS title"""


@query(f"SELECT page_id, url AS source_url, {TITLE} FROM pages")
def page_titles(spark, sf_dir):
    return io.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "source_url", "title")


PAGE_TEXTS = f"""WITH bodies AS (SELECT page_id, url AS source_url, {TITLE},
    regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<h1>([^<]*)</h1>', '<h1># \\1</h1>', 'g') AS body FROM pages),
parts AS (SELECT page_id, source_url, title, list_transform(string_split_regex(body, '<[^>]*>'),
    lambda x: trim(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), chr(32) || chr(9) || chr(10) || chr(13))) AS parts FROM bodies)
SELECT page_id, source_url, title, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM parts"""


@query(PAGE_TEXTS)
def page_texts(spark, sf_dir):
    return io.extract_pages(table(spark, sf_dir, "pages"))


RECORDS = f"rec AS (SELECT concat(source_file, '__chunk_', CAST(row_number() OVER (PARTITION BY source_file ORDER BY ordinal) - 1 AS STRING)) AS chunk_id, text, source_file, business_tag, academic_year FROM ({YEARLY}))"
_REC = ["chunk_id", "text", "source_file", "business_tag", "academic_year"]


def _records(spark, sf_dir):
    return versions.corpus_records(view(spark, sf_dir, YEARLY))


@query(f"WITH {RECORDS} SELECT * FROM rec WHERE trim(text) <> ''")
def corpus_records(spark, sf_dir):
    return _records(spark, sf_dir).select(*_REC)


@query(f"SELECT CASE WHEN academic_year = '' THEN '(未标记)' ELSE academic_year END AS academic_year, count(*) AS chunks FROM ({YEARLY}) GROUP BY ALL")
def year_list(spark, sf_dir):
    return versions.list_years(view(spark, sf_dir, YEARLY))


@query(f"SELECT count(*) AS chunks, count(DISTINCT source_file) AS files FROM ({YEARLY}) WHERE academic_year = '2021-2022'")
def year_preview(spark, sf_dir):
    return versions.preview_delete(view(spark, sf_dir, YEARLY), "2021-2022")


@query(f"SELECT count(*) AS chunks FROM ({YEARLY}) WHERE academic_year = '2022-2023'")
def year_count(spark, sf_dir):
    return versions.count_year(view(spark, sf_dir, YEARLY), "2022-2023")


@query(f"SELECT doc_id, academic_year FROM ({YEARLY}) WHERE NOT (academic_year = '2021-2022' AND source_file IN ('src1', 'src2', 'src3'))")
def year_deleted(spark, sf_dir):
    files = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "source_file string")
    return versions.delete_year(view(spark, sf_dir, YEARLY), "2021-2022", files).select("doc_id", "academic_year")


@query(f"SELECT doc_id FROM ({YEARLY}) WHERE source_file NOT IN ('src1', 'src2')")
def files_removed(spark, sf_dir):
    return versions.remove_files(view(spark, sf_dir, YEARLY), spark.createDataFrame([("src1",), ("src2",)], "source_file string")).select("doc_id")


NEW_DOCS = "SELECT conv_id * 1000 + turn AS ordinal, text, concat('src', CAST(conv_id % 30 AS STRING)) AS source_file, role AS business_tag, 'old' AS academic_year FROM {conversations}"
IMPORTED = f"WITH {RECORDS}, kept AS (SELECT * FROM rec WHERE trim(text) <> ''{{0}}), had AS (SELECT source_file, max(CAST(regexp_extract(chunk_id, '__chunk_([0-9]+)$', 1) AS BIGINT)) + 1 AS had FROM kept GROUP BY ALL) SELECT * FROM kept UNION ALL SELECT concat(n.source_file, '__chunk_', CAST(coalesce(had, 0) + row_number() OVER (PARTITION BY n.source_file ORDER BY ordinal) - 1 AS STRING)), text, n.source_file, business_tag, '2021-2022' FROM ({NEW_DOCS}) n LEFT JOIN had ON n.source_file = had.source_file WHERE trim(text) <> ''"


@query(IMPORTED.replace("{0}", ""))
def docs_imported(spark, sf_dir):
    return versions.import_docs(_records(spark, sf_dir), view(spark, sf_dir, NEW_DOCS), "2021-2022").select(*_REC)


@query(IMPORTED.replace("{0}", " AND academic_year <> '2021-2022'"))
def year_rebuilt(spark, sf_dir):
    return versions.rebuild_year(_records(spark, sf_dir), view(spark, sf_dir, NEW_DOCS), "2021-2022").select(*_REC)


@query(f"WITH {RECORDS} SELECT chunk_id, 'missing_in_vectors' AS state FROM rec WHERE trim(text) <> '' AND academic_year = '2020-2021'")
def store_consistency(spark, sf_dir):
    r = _records(spark, sf_dir)
    return versions.check_consistency(r, versions.delete_year(r, "2020-2021"))


@query(f"SELECT store, academic_year, count(*) AS chunks FROM ({YEARLY}), (VALUES ('corpus'), ('vectors')) AS s(store) WHERE trim(text) <> '' AND academic_year <> '2022-2023' AND (academic_year <> '2021-2022' OR doc_id % 2 = 0) GROUP BY ALL")
def paired_stores(spark, sf_dir):
    """Rows by year of the two stores after all years were put in, one was rebuilt from half its rows, and one was dropped."""
    both, rows = stores.PairedCorpus(spark, new_path(spark, "paired")), view(spark, sf_dir, YEARLY).where("trim(text) <> ''")
    corpus = rows.select("doc_id", "source_file", "academic_year", "text")
    vectors = rows.select("doc_id", "academic_year", F.array(F.length("text").cast("double")).alias("vector"))
    both.rebuild(corpus, vectors)
    half = "academic_year = '2021-2022' AND doc_id % 2 = 0"
    both.rebuild(corpus.where(half), vectors.where(half), ["2021-2022"])
    both.drop("2022-2023")
    counted = [x.groupBy("academic_year").agg(F.count("*").alias("chunks")).withColumn("store", F.lit(n)) for n, x in zip(("corpus", "vectors"), both.read())]
    return counted[0].unionByName(counted[1])


_EXPORT = ["chunk_id", "text", "source_file", "academic_year"]


@query(f"SELECT concat(source_file, '__chunk_', CAST(row_number() OVER (PARTITION BY source_file ORDER BY doc_id) - 1 AS STRING)) AS chunk_id, text, source_file, academic_year FROM ({YEARLY})")
def corpus_exported(spark, sf_dir):
    v = view(spark, sf_dir, YEARLY).withColumnRenamed("doc_id", "chunk").withColumns({c: F.lit(None).cast("string") for c in ("chapter", "chunk_strategy", "heading_path")})
    return io.export_corpus(v).select(*_EXPORT)


# Whole texts with rules at the end of each line, their numbers and words by the document.
RULED = f"SELECT doc_id, concat(replace(text, {NL}, concat(' 比例不超过 ', CAST(doc_id % 9 AS STRING), '%，前 5 %', {NL})), ' 还须同时符合以下条件：（1）不低于 ', CAST(doc_id AS STRING), ' 分以上；（2）没有处分。', CASE doc_id % 3 WHEN 0 THEN '除特殊情况外，上一学年全日制在校学生须通过考核' WHEN 1 THEN '凡违反规定者取消资格，2021 年至 2023 年' ELSE '面向各年级，以公布为准，每学年末' END) AS text FROM {{documents}}"
_COUNTED = " UNION ALL ".join(f"SELECT '{c}' AS pattern_class, '{p}' AS pattern, len(regexp_extract_all(text, '{p}')) AS n FROM t" for c, p in R.PHRASES)


@query(f"WITH t AS ({RULED}), m AS (SELECT * FROM ({_COUNTED}) WHERE n > 0) SELECT pattern_class AS class, pattern, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ROLLUP (pattern_class, pattern)")
def phrase_counts(spark, sf_dir):
    return ground.mine_patterns(view(spark, sf_dir, RULED)).select("class", "pattern", "n")
