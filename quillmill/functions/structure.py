"""Structure marking as column expressions over the array of a text's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import lines, strip

# Numbered lines that become headings, by level, and the limits of a heading's title.
NUMBERS = "一二三四五六七八九十"
HEADINGS = [("## ", rf"^第[{NUMBERS}]+[章节]"), ("### ", rf"^[{NUMBERS}]+、"), ("#### ", r"^\d+(?:\.\d+)*[、.]\s*")]
MAX_TITLE, TITLE_ENDS = 40, "[。；！？]"


def _shifted(flags: Column, by: int) -> Column:
    """flags as seen `by` places further on (or back, below 0); beyond the ends, false."""
    none = F.array_repeat(F.lit(False), abs(by))
    return F.concat(F.slice(flags, by + 1, F.greatest(F.size(flags) - by, F.lit(0))), none) if by > 0 else F.concat(none, flags)


def _with_flags(rows: Column, flags: Column, reach: int) -> Column:
    """Lines with the flags of their neighbours, so that each line is looked at once: x, and f[0..2 * reach]."""
    around = F.arrays_zip(*[_shifted(flags, k) if k else flags for k in range(-reach, reach + 1)])
    return F.zip_with(rows, around, lambda x, f: F.struct(x.alias("x"), F.array(*[F.coalesce(f[str(k)], F.lit(False)) for k in range(2 * reach + 1)]).alias("f")))


def mark_code_blocks(c: Column, least: int = 3) -> Column:
    """Runs of `least` or more code-like lines between fences."""
    rows = lines(c)
    code = F.transform(rows, lambda x: (x.rlike(r"[{}();=<>]") | x.rlike(r"(?U)^\s{4,}\S")) & (strip(x) != ""))
    own = least - 1

    def fenced(e: Column) -> Column:
        f = e["f"]
        follow = before = f[own]
        for k in range(1, least):
            follow, before = follow & f[own + k], before & f[own - k]
        return F.concat(F.when(follow & ~f[own - 1], F.lit("```\n")).otherwise(F.lit("")), e["x"], F.when(before & ~f[own + 1], F.lit("\n```")).otherwise(F.lit("")))

    return F.array_join(F.transform(F.slice(_with_flags(rows, code, own), F.lit(1), F.size(rows)), fenced), "\n")


def normalize_tables(c: Column) -> Column:
    """Table lines stripped, with an empty line before each run of them and after it (not at the end of the text)."""
    rows = lines(c)
    table = F.transform(rows, lambda x: strip(x).startswith("|") & strip(x).endswith("|"))
    turn = lambda e: F.when(e["f"][0] != e["f"][1], F.lit("\n")).otherwise(F.lit(""))
    mark = lambda e: F.concat(turn(e), F.when(e["f"][1], strip(e["x"])).otherwise(e["x"]))
    return F.array_join(F.transform(F.slice(_with_flags(rows, table, 1), F.lit(1), F.size(rows)), mark), "\n")


def normalize_headings(c: Column) -> Column:
    """Short numbered lines become headings of a level by their numbering."""

    def heading(x: Column) -> Column:
        s = strip(x)
        out = x
        for mark, prefix in reversed(HEADINGS):
            title = strip(F.regexp_replace(s, prefix, ""))
            fits = s.rlike(prefix + ".+$") & (title != "") & (F.char_length(title) <= MAX_TITLE) & ~title.rlike(TITLE_ENDS)
            out = F.when(fits, F.concat(F.lit(mark), s)).otherwise(out)
        return out

    return F.array_join(F.transform(lines(c), heading), "\n")


def mark_structures(df: DataFrame, text: str = "text") -> DataFrame:
    """Code, tables and headings marked one after the other, each a column of its own: nested, they would be computed anew
    for each of their uses."""
    for step in (mark_code_blocks, normalize_tables, normalize_headings):
        df = df.withColumn(text, step(F.col(text)))
    return df


def table_to_markdown(cells: Column, pad: bool = True) -> Column:
    """A grid (array of rows of cells) as a Markdown table; pad fits rows to the header's width. An empty grid gives ''."""
    tidy = lambda r: F.transform(r, lambda v: F.regexp_replace(strip(F.coalesce(v, F.lit(""))), "\n", " "))
    head = tidy(F.get(cells, F.lit(0)))
    width = F.size(F.get(cells, F.lit(0)))
    fit = (lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)) if pad else (lambda r: r)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rows = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda r: line(fit(tidy(r))))
    whole = F.concat(F.array(line(head), line(F.transform(head, lambda _: F.lit("---")))), rows)
    return F.when(F.coalesce(F.size(cells), F.lit(0)) <= 0, F.lit("")).otherwise(F.array_join(whole, "\n"))
