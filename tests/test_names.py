"""The nearest name against all names."""

import random

import pytest

from quillmill.operators import names as module
from quillmill.operators.names import nearest_names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest(spark):
    r = random.Random(7)
    names = ["".join(r.choice("abcé日") for _ in range(r.randrange(1, 14))) for _ in range(150)] + ["a" * 40, "学生手册.pdf", "学生守则.pdf"]
    wanted = ["".join(r.choice("abcdé日") for _ in range(r.randrange(0, 16))) for _ in range(40)] + ["学生手则.pdf", "zzzz", "z" * 30, names[3], "a" * 38 + "bb", ""]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string")
    got = {x.wanted: (x.d, x.name) for x in nearest_names(frame([*wanted, None]), frame([*names, names[0], None])).collect()}
    assert got == {w: min((distance(w, n), n) for n in names) for w in wanted}
    assert nearest_names(frame(wanted), frame([])).count() == 0
    assert nearest_names(frame([]), frame(names)).count() == 0


@pytest.mark.parametrize("few", [0, 4096])
def test_wanted_unlike_all(spark, monkeypatch, few):
    """Names that are like none find the same by growing distances and by looking at few names at once; the latter makes no pairs
    of segments."""
    monkeypatch.setattr(module, "FEW", few)
    if few:
        monkeypatch.setattr(module, "_within", None)
    r = random.Random(3)
    names = [f"{a} {b}" for a in ("hot", "cold", "blue") for b in ("ring", "gear", "bolt")]
    wanted = [f"~{i}" for i in range(30)] + ["".join(r.choice("hotrinage ") for _ in range(r.randrange(1, 12))) for _ in range(30)] + ["hot ring"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string")
    got = {x.wanted: (x.d, x.name) for x in nearest_names(frame(wanted), frame(names)).collect()}
    assert got == {w: min((distance(w, n), n) for n in names) for w in wanted}
