"""Repair of conversations against a walk over the grammar's states that keeps the least (cost, audit) of each."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("quillmill.llm")

from quillmill.llm import turns  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, cost string, late string"


def expected(rows):
    space = lambda x: " " if x is None else str(x)
    conversations = {}
    for conv, turn, role, text in rows:
        kept = conversations.setdefault(conv, [])
        hit = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if hit == 4 else space(role), space(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        kept += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    for conv, kept in conversations.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in kept if t is not None]
        best = _inserted({0: (0, "", ())})
        for (_, role, text), fault in zip(kept, faults):
            new = {}
            for state, (cost, audit, out) in best.items():
                ways = [(state, cost + 3, audit + "D", out)]
                if fault not in ("b", "d"):
                    more, name, to = int(fault == "t"), ("assistant", "user")[state != 3], 2 if state == 3 else 3
                    ways.append((to, cost + 2 + more, audit + "R", (*out, f"{name}:{text}")))
                    if role[:1] == name[0]:
                        ways.append((to, cost + more, audit + "K", (*out, f"{role}:{text}")))
                    if role[:1] == "s" and state == 0:
                        ways.append((1, cost + more, audit + "K", (*out, f"{role}:{text}")))
                for to, *way in ways:
                    new[to] = min(new.get(to, tuple(way)), tuple(way), key=lambda x: x[:2])
            best = _inserted(new)
        cost, audit, out = min((v for k, v in best.items() if k in (0, 2)), key=lambda x: x[:2])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        yield conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def _inserted(best):
    for _ in range(2):
        for state, (cost, audit, out) in list(best.items()):
            to, line = (2, "assistant:") if state == 3 else (3, "user:")
            way = (cost + 2, audit + "I", (*out, line))
            best[to] = min(best.get(to, way), way, key=lambda x: x[:2])
    return best


def rows():
    r = random.Random(3)
    texts = ["Hi.", "No", "Yes!", " ", None, "", "\t\n", "Sure?  "]
    out = [(1000 + i % 60, r.choice([None, *range(12)]), r.choice(["user", "assistant", "system", "s", "", None, "tool"]), r.choice(texts)) for i in range(700)]
    out += [(5, i, r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice([*texts, f"line {i}.", f"word {i}"])) for i in range(900)]
    return [*out, (None, 1, "user", "a."), (None, None, "assistant", "b."), (7, None, None, None), (8, 1, "system", "x" * 100_000), *[(9, 1, "user", "same.")] * 40]


@pytest.mark.parametrize("piece", [256, 3])
def test_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(turns, "PIECE", piece)
    data = rows()
    frame = spark.createDataFrame([(*x, "a", "b") for x in data], SCHEMA).repartition(5)
    got = {tuple(x) for x in turns.repair_conversations(frame).collect()}
    assert got == set(expected(data))
    assert turns.repair_conversations(frame.limit(0)).count() == 0


def test_all_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = [tuple(x) for x in turns.repair_conversations(spark.createDataFrame([(gone, 0, "user", "a.", "", "")], SCHEMA)).collect()]
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("entry", range(4))
@pytest.mark.parametrize("leave", range(4))
def test_bands_lose_nothing(entry, leave):
    """Every pair of states, against all scripts of edits."""
    r = random.Random(entry * 4 + leave)
    for _ in range(60):
        data = [(r.choice("suax"), r.random() < 0.3, r.random() < 0.3) for _ in range(r.randrange(1, 7))]
        best = _inserted({entry: (0, "", ())})
        for initial, forced, truncated in data:
            new = {}
            for state, (cost, audit, out) in best.items():
                ways, want, to = [(state, cost + 3, audit + "D", out)], "a" if state == 3 else "u", 2 if state == 3 else 3
                if not forced:
                    ways.append((to, cost + truncated + 2 * (initial != want), audit + ("K" if initial == want else "R"), out))
                    if initial == "s" and state == 0:
                        ways.append((1, cost + truncated, audit + "K", out))
                for to, *way in ways:
                    new[to] = min(new.get(to, tuple(way)), tuple(way))
            best = _inserted(new)
        got = turns.align(data, (entry,), (leave,)).get((entry, leave))
        assert got == (best[leave][:2] if leave in best else None)
