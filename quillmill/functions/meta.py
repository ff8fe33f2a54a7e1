"""Metadata of documents by rules over the file name's stem and the first part of the text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .clean import strip


def _any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def _first_rule(c: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The name of the first rule with a word in c, else null."""
    return F.coalesce(*[F.when(_any(c, words), F.lit(name)) for name, words in table])


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def business_tag(stem: Column, body: Column, tags=rules.TAGS, markers=rules.MARKERS) -> Column:
    """A keyword in the stem, else a marker in the first 2000 characters, else most keywords there (the earlier tag on ties)."""
    head = F.left(body, F.lit(2000))
    count = lambda w: (F.char_length(head) - F.char_length(F.replace(head, F.lit(w), F.lit("")))) / len(w)
    scores = F.array(*[F.struct(reduce(lambda a, b: a + b, [count(w) for w in words]).cast("int").alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, words) in enumerate(tags)])
    best = F.array_max(scores)
    return F.coalesce(_first_rule(stem, tags), _first_rule(head, markers), F.when(best["n"] > 0, best["t"]), F.lit(rules.OTHER_TAG))


# How years, semesters and dates are written.
YEARS = [(r"(\d{4})[-—](\d{4})", 2), (r"(\d{4})\s*年", 1), (r"(\d{4})级", 1), (r"(\d{4})", 1)]


def _range(c: Column) -> Column:
    p = YEARS[0][0]
    return F.when(c.rlike(p), F.concat(_group(c, p, 1), F.lit("-"), _group(c, p, 2)))


def _semester(c: Column) -> Column:
    p = r"(\d{4})[-—](\d{4})学年.*?第([一二])学期"
    return F.when(c.rlike(p), F.concat_ws("-", _group(c, p, 1), _group(c, p, 2), _group(c, p, 3)))


def academic_year(stem: Column, body: Column) -> Column:
    found = lambda c: [_range(c)] + [_nonempty(_group(c, p, 1)) for p, _ in YEARS[1:]]
    return F.coalesce(*found(stem), *found(F.left(body, F.lit(500))), F.lit(""))


def effective_date(stem: Column, body: Column) -> Column:
    head = F.left(body, F.lit(500))
    return F.coalesce(_semester(stem), _range(stem), _nonempty(_group(stem, r"(\d{4})年", 1)), _semester(head), _range(head), F.lit(""))


def chapter(body: Column) -> Column:
    return F.trim(F.regexp_extract(body, r"(?m)^#+\s+(.+)$", 1))


def doc_type(stem: Column, body: Column) -> Column:
    return F.coalesce(_first_rule(stem, rules.TYPE_BY_NAME), _first_rule(F.left(body, F.lit(2000)), rules.TYPE_BY_TEXT), F.lit(rules.POLICY))


def scope(stem: Column, body: Column) -> Column:
    return F.coalesce(_first_rule(stem, rules.SCOPE_BY_NAME), _first_rule(F.left(body, F.lit(1000)), rules.SCOPE_BY_TEXT), F.lit(""))


def update_date(body: Column, modified: Column) -> Column:
    """The first written date of the first 1000 characters as YYYY-MM-DD, else the file's."""
    head = F.left(body, F.lit(1000))
    day = lambda p: F.when(head.rlike(p), F.concat_ws("-", _group(head, p, 1), F.lpad(_group(head, p, 2), 2, "0"), F.lpad(_group(head, p, 3), 2, "0")))
    return F.coalesce(day(r"(\d{4})年(\d{1,2})月(\d{1,2})日"), day(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"), F.date_format(modified, "yyyy-MM-dd"))


def extract_metadata(df: DataFrame, name: str = "source_file", body: str = "text", modified: str | None = None, loader: tuple[str, ...] = ()) -> DataFrame:
    """df with its metadata columns; those named in loader keep the value that the reader gave where there is one."""
    stem, text = file_stem(F.col(name)), F.coalesce(F.col(body), F.lit(""))
    new = {
        "file_type": F.lower(F.regexp_extract(F.col(name), r"\.[^.]+$", 0)), "business_tag": business_tag(stem, text), "academic_year": academic_year(stem, text), "chapter": chapter(text),
        "update_time": update_date(text, F.col(modified) if modified else F.lit(None).cast("timestamp")), "doc_type": doc_type(stem, text), "effective_date": effective_date(stem, text), "scope": scope(stem, text),
    }
    return df.withColumns({k: F.coalesce(F.col(k), v) if k in loader else v for k, v in new.items()})


# File name parts of readable titles.
_EXTENSION, _NUMBER, _DOCUMENT_NUMBER = r"(?i)\.(pdf|docx?|txt)$", r"^\d+\s*", r"浙工大发[〔\[]\d{4}[〕\]]\d+号"
_TITLES = [r"(浙江工业大学.+?(?:管理办法|评定办法|实施办法|申请操作|招募通知|提交指南|补充说明|认定办法|命题范围|名额分布))", r"(\d{4}.+?培养计划)", r"(关于.+?通知)"]


def doc_title(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, _EXTENSION, ""), _NUMBER, ""), _DOCUMENT_NUMBER, "")
    return F.coalesce(*[_nonempty(_group(s, p, 1)) for p in _TITLES], _nonempty(strip(s)), name)


_MARK = r"第[一二三四五六七八九十百千\d]+"


def article_mark(text: Column) -> Column:
    """The first article mark, else the first chapter mark, else the first section mark, else ''."""
    found = F.regexp_extract_all(text, F.lit(f"({_MARK}[条章节])"), 1)
    pick = lambda end: F.try_element_at(F.filter(found, lambda m: F.contains(m, F.lit(end))), F.lit(1))
    return F.coalesce(pick("条"), pick("章"), F.try_element_at(found, F.lit(1)), F.lit(""))


def chapter_mark(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?U)({_MARK}章\s*\S+)", 1)


def query_tag(query: Column, tags=rules.TAGS) -> Column:
    return F.coalesce(_first_rule(query, tags), F.lit(""))


def query_key(query: Column) -> Column:
    return F.md5(query)


def parse_rewrites(text: Column) -> Column:
    """The rewritten queries of a model's reply, one a line, without numbering and marks."""
    rows = F.transform(F.split(strip(text), "\n", -1), lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), r"^\d+[.、)\] ]+\s*", ""), r"^[*`]+|[*`]+$", "")))
    return F.filter(rows, lambda x: x != "")
