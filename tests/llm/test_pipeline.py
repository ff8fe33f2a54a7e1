"""The pipeline's stages keep the columns of documents and what is clean; the last one packs all that is left."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        assert 0 < docs.count() <= n, name
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


SCHEMA = "doc_id long, text string, n_chars long, score string, predicted string, n_words string, n_lines string, content string, contaminated string, weight string"
LINE = "these are the words of one line that another document repeats as it is"


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, and extra columns named as the operators' outputs."""
    texts = [(1, LINE + "\nand so on"), (1, LINE + "\nand so on"), (2, LINE), (2, "all of this text is its own and so it stays where it is"), (3, None), (4, ""), (None, LINE), (None, None), (5, "long " + " ".join(f"w{i}" for i in range(20_000)))]
    return [(i, t, None if t is None else len(t), *(f"{c}{k}" for c in "abcdefg")) for k, (i, t) in enumerate(texts)]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    sf, rows = "/root/testdata/sf0.001", odd_rows()
    got = stage(spark, spark.createDataFrame(rows, SCHEMA), sf)
    out = got.collect()
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0
    if name == "packing":
        assert sorted(str(r.doc_id) for r in out if r.piece == 0) == sorted(str(r[0]) for r in rows)
        return
    assert got.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    known = {r[3]: r for r in rows}
    assert all(tuple(r)[3:] == known[r.score][3:] and r.doc_id == known[r.score][0] for r in out)
    left = sorted(r.score for r in out)
    if name == "line dedup":
        changed = {r.score: (r.text, r.n_chars) for r in out if (r.text, r.n_chars) != known[r.score][1:3]}
        assert len(left) == len(rows) and changed == {"a2": ("", 0)}
    elif name == "near-dedup":
        # One row of each class: the repeated text, the line (rows 2 and 6), the other, those without words, the long one.
        assert [k for k in left if k not in ("a0", "a1")] == ["a2", "a3", "a4", "a8"] and len(left) == 5
    elif name == "decontamination":
        assert left == sorted(known)
    else:
        assert ("a0" in left) == ("a1" in left) and ("a4" in left) == ("a5" in left) == ("a7" in left)
