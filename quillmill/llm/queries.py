"""Registered queries of the operators, each over its whole table, and their DuckDB forms where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bestfit, decontaminate, lines, media, neardup, packed, phrases, pii, quality, substrings, toxicity, turns, vectors
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


OP3_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
cut AS (SELECT item_id, w, least(13, len(w)) AS k FROM item WHERE len(w) > 0),
gram AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut)),
place AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM gram) WHERE len(w) >= k),
hit AS (SELECT doc_id, item_id, i, p.k FROM (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM place) p JOIN gram USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS word FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op1_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(docs(spark, sf_dir))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.find(docs(spark, sf_dir)).drop("redacted", "n_added")


@query("op3_decontaminate", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words against every text."""
    found = decontaminate.decontaminate(docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text."""
    return toxicity.classify(spark, sf_dir, docs(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of earlier documents' 50-byte strings."""
    return substrings.remove_repeats(docs(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every text."""
    return quality.classify(spark, sf_dir, docs(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")


@query("op7_media_columns")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a medium, carved from a blob and read back."""
    return media.text_media(docs(spark, sf_dir))


@query("op8_packed_matrices")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id matrices of 1024 columns of every text."""
    return packed.pack_matrices(docs(spark, sf_dir))


OP9_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS no FROM cut),
worded AS (SELECT doc_id, no, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM numbered),
used AS (SELECT doc_id, no, w, array_to_string(w, ' ') AS full_line FROM worded WHERE len(w) > 0),
firsts AS (SELECT full_line, min({'doc_id': doc_id, 'no': no}) AS pos, any_value(w) AS w FROM used GROUP BY full_line),
gone AS (
  SELECT full_line, pos, array_to_string(list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, len(w))), ' ') AS v, i, len(w) AS n
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 8)),
near AS (
  SELECT a.pos FROM gone a JOIN (SELECT v, i, n, min(pos) AS pos FROM gone GROUP BY v, i, n) b ON a.v = b.v AND a.i = b.i AND a.n = b.n AND b.pos < a.pos
  UNION SELECT l.pos FROM gone l JOIN firsts s ON l.v = s.full_line AND s.pos < l.pos AND len(s.w) >= 8
  UNION SELECT s.pos FROM gone l JOIN firsts s ON l.v = s.full_line AND l.pos < s.pos AND len(s.w) >= 8),
out AS (
  SELECT doc_id, no, false AS near FROM used u JOIN firsts f ON u.full_line = f.full_line AND f.pos < {'doc_id': u.doc_id, 'no': u.no}
  UNION ALL SELECT pos.doc_id, pos.no, true FROM near),
left_over AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.no) AS text FROM numbered n LEFT JOIN out o ON n.doc_id = o.doc_id AND n.no = o.no WHERE o.no IS NULL GROUP BY n.doc_id),
sums AS (SELECT doc_id, count(DISTINCT no) AS n_removed, count(DISTINCT CASE WHEN near THEN no END) AS n_near FROM out GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text
FROM documents d LEFT JOIN left_over l ON d.doc_id = l.doc_id LEFT JOIN sums s ON d.doc_id = s.doc_id
"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that an earlier line repeats, up to one word."""
    return lines.dedup_lines(docs(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "n_near", "text")


@query("op10_best_fit")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 1024 tokens as best fit finds."""
    return bestfit.pack(docs(spark, sf_dir))


OP11_SQL = r"""
WITH hashed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS h
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS body FROM damaged),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         concat(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n), left(role, 1)) AS pair
  FROM placed),
gathered AS (
  SELECT conv_id, count(*) AS n, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list({'role': role, 'text': text} ORDER BY n) AS turns,
         list({'c0': 0, 'a0': '', 'c1': 1000000, 'a1': '', 'c2': 4, 'a2': 'II', 'c3': 2, 'a3': 'I', 'i': left(role, 1), 'gone': fault IN ('blank', 'duplicate'), 't': CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END} ORDER BY n) AS rows
  FROM judged GROUP BY conv_id),
aligned AS (
  SELECT *, list_reduce(rows, lambda x, y: list_transform(list_transform([{
      'n0': {'c': x.c0 + 3, 'a': x.a0 || 'D'},
      'n1': list_min([{'c': x.c1 + 3, 'a': x.a1 || 'D'}, {'c': CASE WHEN y.i = 's' AND NOT y.gone THEN x.c0 + y.t ELSE 1000000 END, 'a': x.a0 || 'K'}]),
      'n2': list_min([{'c': x.c2 + 3, 'a': x.a2 || 'D'}, {'c': CASE WHEN y.gone THEN 1000000 WHEN y.i = 'a' THEN x.c3 + y.t ELSE x.c3 + y.t + 2 END, 'a': x.a3 || CASE WHEN y.i = 'a' THEN 'K' ELSE 'R' END}]),
      'n3': list_min([{'c': x.c3 + 3, 'a': x.a3 || 'D'}] || list_transform([{'c': x.c0, 'a': x.a0}, {'c': x.c1, 'a': x.a1}, {'c': x.c2, 'a': x.a2}], lambda z: {'c': CASE WHEN y.gone THEN 1000000 WHEN y.i = 'u' THEN z.c + y.t ELSE z.c + y.t + 2 END, 'a': z.a || CASE WHEN y.i = 'u' THEN 'K' ELSE 'R' END}))}],
      lambda m: {'n0': m.n0, 'n1': m.n1, 'n2': m.n2, 'n3': list_min([m.n3, {'c': m.n0.c + 2, 'a': m.n0.a || 'I'}, {'c': m.n1.c + 2, 'a': m.n1.a || 'I'}, {'c': m.n2.c + 2, 'a': m.n2.a || 'I'}])}),
      lambda m: {'c0': m.n0.c, 'a0': m.n0.a, 'c1': m.n1.c, 'a1': m.n1.a, 'c2': least(m.n2.c, m.n3.c + 2), 'a2': list_min([m.n2, {'c': m.n3.c + 2, 'a': m.n3.a || 'I'}]).a, 'c3': m.n3.c, 'a3': m.n3.a, 'i': y.i, 'gone': y.gone, 't': y.t})[1],
    {'c0': 0, 'a0': '', 'c1': 1000000, 'a1': '', 'c2': 4, 'a2': 'II', 'c3': 2, 'a3': 'I', 'i': '', 'gone': false, 't': 0}) AS e
  FROM gathered),
decided AS (SELECT *, list_min([{'c': e.c0, 'a': e.a0}, {'c': e.c2, 'a': e.a2}]) AS best FROM aligned),
rendered AS (
  SELECT *, list_reduce(list_transform(CASE WHEN best.a = '' THEN [] ELSE string_split(best.a, '') END, lambda x: {'edit': x, 'at': CAST(0 AS BIGINT), 'state': CAST(0 AS BIGINT), 'lines': CAST([] AS VARCHAR[])}),
    lambda x, y: {'edit': y.edit, 'at': x.at + CASE WHEN y.edit = 'I' THEN 0 ELSE 1 END,
      'state': CASE WHEN y.edit = 'D' THEN x.state WHEN y.edit = 'K' AND x.state = 0 AND left(turns[x.at + 1].role, 1) = 's' THEN 1 WHEN x.state = 3 THEN 2 ELSE 3 END,
      'lines': x.lines || CASE y.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [concat(turns[x.at + 1].role, ':', turns[x.at + 1].text)]
        ELSE [concat(CASE WHEN x.state = 3 THEN 'assistant' ELSE 'user' END, ':', CASE WHEN y.edit = 'R' THEN turns[x.at + 1].text ELSE '' END)] END},
    {'edit': '', 'at': CAST(0 AS BIGINT), 'state': CAST(0 AS BIGINT), 'lines': CAST([] AS VARCHAR[])}).lines AS lines
  FROM decided)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN rendered r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""


@query("op11_repair_conversations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return turns.repair_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP12_SQL = """
WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS rn, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT rn, vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM numbered WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND list_dot_product(e, e) > 0),
pair AS (SELECT a.rn AS x, b.rn AS y, b.vec_id AS id FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rn <> b.rn WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT x, y, id FROM pair UNION SELECT r.x, p.y, p.id FROM reach r JOIN pair p ON p.x = r.y),
linked AS (SELECT x AS rn, count(*) AS n FROM pair GROUP BY x),
least AS (SELECT x AS rn, min(id) AS id FROM reach GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(id, vec_id)) AS component_id, coalesce(vec_id = least(vec_id, coalesce(id, vec_id)), false) AS kept
FROM numbered LEFT JOIN linked USING (rn) LEFT JOIN least USING (rn)
"""


@query("op12_near_vectors", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 within every label, and their components."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


OP13_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
gram AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)),
known AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM gram GROUP BY lang, k, phrase HAVING count(*) >= 10),
cut AS (SELECT lang, phrase, f AS a, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, size), ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM known WHERE size > 1)),
scored AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cut c JOIN known x ON x.lang = c.lang AND x.phrase = c.x JOIN known y ON y.lang = c.lang AND y.phrase = c.y),
best AS (SELECT lang, phrase, a, min({'score': score, 'k': k, 'l': l, 'r': r}) AS b FROM scored GROUP BY lang, phrase, a),
around AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM known WHERE size = 3) GROUP BY lang, phrase),
ranked AS (SELECT b.lang, b.phrase, b.a, b.b.l AS l, b.b.r AS r, b.b.score AS score, row_number() OVER (PARTITION BY b.lang ORDER BY b.b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100 * CAST(o.longer AS HUGEINT) < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of two and three words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))
