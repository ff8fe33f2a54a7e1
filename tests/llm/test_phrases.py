"""Collocations against counts of all n-grams."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quillmill.llm")

from quillmill.llm import phrases  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def expected(rows, least=10, longest=3, share=50, top=2000):
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        gone = {p[i : i + m] for p, a in known.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= share * known[p[i : i + m]]}
        found = []
        for p, a in known.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, phrase.decode(), -a, l, r, words[lang], -score


def rows():
    r = random.Random(4)
    names = ["New York City", "new\tyork  city", "süß Ö é", "İ x", "der Hund", "日本 語", "a a a a", "x\x0by", "no way!", "AB:cd;ef"]
    texts = [(" ".join(r.choice(names) if r.random() < 0.4 else r.choice("abcdefgh") for _ in range(60)), r.choice(["en", "de", None, "", "a\nb"])) for _ in range(80)]
    return [*texts, *[texts[0]] * 12, (None, "en"), ("", None), (" \t. ,", "fr"), ("z " * 50_000, "en"), ("alone", "xx")]


@pytest.mark.parametrize("held", [3_000_000, 50])
def test_collocations(spark, monkeypatch, held):
    monkeypatch.setattr(phrases, "HELD", held)
    data = rows()
    frame = spark.createDataFrame([(i, *x, "p", 1) for i, x in enumerate(data)], SCHEMA).repartition(5)
    got = sorted(tuple(x) for x in phrases.collocations(frame).collect())
    assert got == sorted(expected(data))
    assert len(got) > 50
    few = sorted(tuple(x) for x in phrases.collocations(frame, top=3, longest=4, least=5, share=80, salts=2).collect())
    assert few == sorted(expected(data, 5, 4, 80, 3))
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_steps_and_collisions(monkeypatch):
    monkeypatch.setattr(phrases, "STEP_WORDS", 3)
    text = "Ab cd. ef gh ij kl mn, op"
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array([text, "ef gh"]), "lang": pa.array(["en", "en"])})
    got = Counter(buffer[a:b].tobytes().decode() for _, _, s, e, _, buffer in phrases.grams(batch, 3) for a, b in zip(s, e))
    assert got == {"ab": 1, "cd": 1, "ab cd": 1, "ef": 2, "gh": 2, "ij": 1, "kl": 1, "mn": 1, "ef gh": 2, "gh ij": 1, "ij kl": 1, "kl mn": 1, "ef gh ij": 1, "gh ij kl": 1, "ij kl mn": 1, "op": 1}
    # Texts that share a key are told apart.
    data = np.frombuffer(b"abacab", np.uint8)
    key, count, start, lens = phrases.added(np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 3, 4]), np.array([0, 2, 4, 0]), np.array([2, 2, 2, 1]), data)
    assert sorted(zip(key.tolist(), count.tolist(), [data[a : a + n].tobytes() for a, n in zip(start, lens)])) == [(5, 2, b"ac"), (5, 4, b"ab"), (7, 4, b"a")]
