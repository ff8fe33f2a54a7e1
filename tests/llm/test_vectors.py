"""Links of vectors against all pairs."""


import numpy as np
import pytest

pytest.importorskip("quillmill.llm")

from quillmill.llm import vectors  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n_links int"


def expected(rows, near=0.98):
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and usable(v)]
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.asarray(rows[k][1], np.float32).astype(float) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= near:
                    links[a].add(b)
                    links[b].add(a)
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            todo = [b for a in todo for b in links[a] if b not in seen and not seen.add(b)]
        least = None if i is None else min(rows[b][0] for b in seen)
        yield i, len(links[k]), least, i is not None and least == i


def made(seed=5, dim=64):
    r = np.random.default_rng(seed)
    out = []
    for c in range(60):
        center = r.standard_normal(dim)
        for _ in range(int(r.integers(1, 9))):
            out.append((len(out), (center + r.normal(0, r.choice([0.05, 0.13, 0.2]), dim)).tolist(), int(c % 3)))
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = made() + [(9000 + i, made(6)[0][1], 1) for i in range(30)]
    frame = spark.createDataFrame([(*x, "n", 3) for x in rows], SCHEMA).repartition(4)
    got = {tuple(x) for x in vectors.near_vectors(frame).collect()}
    assert got == set(expected(rows))
    assert sum(x[1] for x in got) > 500


def test_odd_rows(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e, 1), (2, [2.0, 0.0, 0.0], 1), (3, e, None), (None, e, 1), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [float("nan"), 1.0, 1.0], 1), (8, [None, 1.0, 0.0], 1)]
    rows += [(9, [float("inf"), 0.0, 0.0], 1), (10, e, 2), (11, e, 2), (11, e, 2), (12, [1.0, 0.0], 1), (13, [-1.0, 0.0, 0.0], 1), (14, [0.0, 1e-30, 0.0], 1), (15, [-0.0, 1e30, 0.0], 1)]
    frame = spark.createDataFrame([(*x, "n", 3) for x in rows], SCHEMA)
    got = [tuple(x) for x in vectors.near_vectors(frame).collect()]
    want = dict(zip([tuple(map(str, x)) for x in rows], expected(rows)))
    assert sorted(map(str, got)) == sorted(str(x) for x in expected(rows)), want
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_estimates_are_right_on_average():
    r = np.random.default_rng(2)
    d = 64
    a, b = r.standard_normal((2, 4000, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = 0.9 * a + 0.05 * b
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    (signs, _, noise), (_, other, _) = (vectors.decode(vectors.encode(x), d) for x in (a, b))
    off = (signs * other).sum(axis=1) - (a * b).sum(axis=1)
    assert abs(off.mean()) < 0.003
    sine = 1 - (a * b).sum(axis=1).mean() ** 2
    assert off.std() < 1.1 * np.sqrt(sine * noise[0].mean() + noise[1].mean())


def test_keys_meet_near_pairs():
    bits, tables = vectors.key_shape(5000, 0.98)
    r = np.random.default_rng(1)
    a = vectors.unit(r.standard_normal((3000, 64)))
    side = r.standard_normal((3000, 64))
    side = vectors.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    salt = np.zeros(3000, np.uint64)
    shared = (vectors.keys(a, salt, bits, tables) == vectors.keys(b, salt, bits, tables)).any(axis=1)
    assert shared.mean() > 0.999
    apart = (vectors.keys(a, salt, bits, tables) == vectors.keys(side, salt, bits, tables)).any(axis=1)
    assert apart.mean() < 0.02
