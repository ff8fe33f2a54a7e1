"""The operators on small fixtures against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("quillmill.llm")

from pyspark.sql import functions as F  # noqa: E402

from quillmill.llm import bestfit, decontaminate, lines, media, neardup, packed, pii, substrings, tokens, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(1, 120)
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("w1 ", "w2 ", 1)), (4, None), (5, ""), (6, "é" * 20), (7, prose(7, 3000)), (8, "start " + BASE[:200] + "\n" + prose(8, 40)),
    (None, BASE), (9, "one line here with nine words in it all\nshort\none line here with ten words in it all"), (10, "One line here with nine words in it, all!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hot", [4096, 2])
def test_substrings(docs, none, hot):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs, hot=hot).collect())
    want = []
    for i, t in TEXTS:
        b = (t or "").encode()
        earlier = [(u or "").encode() for j, u in TEXTS if None not in (i, j) and j < i]
        hit = [False] * len(b)
        for p in range(len(b) - 49):
            if any(b[p : p + 50] in e for e in earlier):
                hit[p : p + 50] = [True] * 50
        kept = bytes(x for x, h in zip(b, hit) if not h)
        want.append((i or -1, len(b), sum(hit), sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit)), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
    assert substrings.remove_repeats(none, hot=hot).count() == 0


def test_longest_previous_factors():
    import numpy as np

    r = random.Random(4)
    for size in (3, 9):
        for _ in range(60):
            text = bytes(r.choice(b"ab") for _ in range(60))
            at = sorted(range(len(text) - size - 8), key=lambda i: (text[i : i + size], r.random()))
            value = np.array([r.randrange(6) for _ in at])
            word = np.ndarray((len(text) - 7,), ">u8", np.frombuffer(text, np.uint8), strides=(1,))
            same = lambda a, b: next((k for k in range(size) if text[a + k] != text[b + k]), size)  # noqa: E731, B023
            lcp = substrings.common_prefixes(word, np.array(at), size)
            assert lcp.tolist() == [0] + [same(a, b) for a, b in zip(at, at[1:])]
            for least in (1, size):
                longest, source = substrings.longest_previous(value, lcp, least)
                for i, a in enumerate(at):
                    want = max([same(a, b) for j, b in enumerate(at) if value[j] < value[i]], default=0)
                    assert longest[i] == want if want >= least else longest[i] < least
                    assert want < least or source[i] < value[i]


@pytest.mark.parametrize("hot", [4096, 9, 2])
def test_substrings_of_periodic_texts(spark, hot):
    """Few letters, repeated ids and rows in no order: every window has many contexts; hot anchors go by window."""
    r = random.Random(8)
    unit = ["".join(r.choice("ab ") for _ in range(n)) for n in (3, 20, 70)]
    texts = [(r.randrange(30), "".join(r.choice(unit) for _ in range(r.randrange(1, 12))) * r.randrange(1, 3)) for _ in range(50)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans) for x in substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), hot=hot).collect())
    want = []
    for i, t in texts:
        earlier = {u[p : p + 50] for j, u in texts if j < i for p in range(len(u) - 49)}
        hit = [False] * len(t)
        for p in range(len(t) - 49):
            if t[p : p + 50] in earlier:
                hit[p : p + 50] = [True] * 50
        want.append((i, len(t), sum(hit), sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))))
    assert got == sorted(want) and sum(w[2] for w in want)


def _shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_copies_of_long_texts_are_not_looked_up_by_window(spark):
    """Whole and edited copies of long texts, in no order and one without id: right, and shuffled as pieces."""
    r = random.Random(11)
    texts = [(100 + i, prose(40 + i, 2500)) for i in range(8)]
    edited = lambda t: t[:3000] + "~" + t[3001:9000] + t[9010:]
    copies = [(200 + 10 * k + i, edited(t) if k == 3 else "Before. " + t if k == 4 else t) for k in range(6) for i, (_, t) in enumerate(texts)] + [(7, texts[0][1]), (None, texts[1][1])]
    r.shuffle(copies)
    began = _shuffled(spark)
    substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    alone = _shuffled(spark) - began
    got = sorted((x.doc_id or -1, x.n_bytes, x.n_removed, x.n_spans) for x in substrings.remove_repeats(spark.createDataFrame(texts + copies, "doc_id long, text string")).collect())
    both = _shuffled(spark) - began - alone
    seen, want = set(), [(-1, len(texts[1][1]), 0, 0)]
    for i, t in sorted((x for x in texts + copies if x[0]), key=lambda x: x[0]):
        windows = [t[p : p + 50] for p in range(len(t) - 49)]
        hit = [False] * len(t)
        for p, w in enumerate(windows):
            if w in seen:
                hit[p : p + 50] = [True] * 50
        seen.update(windows)
        want.append((i, len(t), sum(hit), sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))))
    assert got == sorted(want)
    assert both < 4 * alone + 200_000, (alone, both)


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(BASE.split()[5:25])), (2, "W3"), (3, None), (None, BASE), (1, " ".join(BASE.split()[5:25]))], "item_id long, text string")
    for rows in (400_000, 3):  # one block, and several passes
        got = decontaminate.decontaminate(docs, bench, block_rows=rows).collect()
        assert len(got) == len(TEXTS)
        for r in got:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower())
            hit, items = set(), set()
            for item, gram in ((1, BASE.split()[5:25]), (2, ["w3"])):
                k = min(13, len(gram))
                for g in range(len(gram) - k + 1):
                    for p in range(len(words) - k + 1):
                        if words[p : p + k] == gram[g : g + k]:
                            hit |= set(range(p, p + k))
                            items.add(str(item))
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_lines(docs, none):
    got = {(r.doc_id, r.text): r for r in lines.dedup_lines(docs).collect()}
    assert len(got) == len({(i, t if i not in (2, 3, 8, 9, 10) else None) for i, t in TEXTS})
    by_id = {r.doc_id: r for r in got.values()}
    assert by_id[1].text == BASE and by_id[2].text == "" and by_id[3].n_near == 1 and by_id[4].text is None and by_id[None].text == BASE
    assert by_id[9].text == "one line here with nine words in it all\nshort" and by_id[10].text == "" and by_id[10].n_near == 0
    assert by_id[9].lang == "en"
    assert lines.dedup_lines(none).count() == 0
    assert lines.one_edit(list("abc"), list("abdc")) and not lines.one_edit(list("abc"), list("acb"))


def test_lines_in_any_row_order(spark):
    line, edited, other = "one line here with nine words in it all", "one line here with ten words in it all", "one line there with nine words in it all"
    rows = [(5, line), (3, edited), (2, line), (2, line + "\n" + prose(11, 20)), (1, other)]
    for given in (rows[:3], rows[2::-1], rows[1:], rows[:0:-1]):
        got = sorted((r.doc_id, r.text, r.n_near) for r in lines.dedup_lines(spark.createDataFrame(given, "doc_id long, text string").coalesce(1)).collect())
        if (1, other) in given:
            assert got == [(1, other, 0), (2, "", 1), (2, prose(11, 20), 1), (3, "", 1)]
        else:
            assert got == [(2, line, 0), (3, "", 1), (5, "", 0)]


def test_short_lines_and_lines_of_one_word_repeat_exactly(spark):
    rows = [(2, "All rights reserved.\n---\n\n\u4e2d\u6587\u3002"), (1, "---\n\nall rights RESERVED\n\u4e2d\u6587\u3002\nyes"), (1, "all rights RESERVED"), (3, "yes\nno\nyes\nno")]
    got = sorted((r.doc_id, r.text, r.n_removed, r.n_near) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "---\n\n\u4e2d\u6587\u3002\nyes", 1, 0), (1, "all rights RESERVED", 0, 0), (2, "---\n", 2, 0), (3, "no", 3, 0)]


def test_lines_against_brute_force(spark):
    r = random.Random(9)
    base = [[r.choice(WORDS[:30]) for _ in range(r.choice((3, 7, 8, 9, 12)))] for _ in range(25)]

    def edited(words):
        words = list(words)
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            i = r.randrange(len(words) + 1)
            kind = r.choice("idr")
            words[i : i + (kind != "i")] = [] if kind == "d" else [r.choice(WORDS)]
        return words

    rows = [(i, "\n".join(" ".join(edited(r.choice(base))) for _ in range(r.randrange(6)))) for i in range(60)]
    flat = [(i, k, t.split()) for i, text in rows for k, t in enumerate(text.split("\n")) if t.split()]
    firsts = {}
    for i, k, w in sorted(flat):
        firsts.setdefault(tuple(w), (i, k))
    near = {firsts[w] for w in firsts if len(w) >= 8 and any(len(o) >= 8 and firsts[o] < firsts[w] and lines.one_edit(list(o), list(w)) for o in firsts if o != w)}
    equal = {(i, k) for i, k, w in flat if firsts[tuple(w)] < (i, k)}
    want = {i: (len(text.split("\n")), sum((i, k) in near | equal for k in range(9)), sum((i, k) in near for k in range(9))) for i, text in rows}
    r.shuffle(rows)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_lines, x.n_removed, x.n_near) for x in got} == want and len(near) > 10


def test_near_duplicates(docs, none):
    got = sorted((r.doc_id or -1, r.class_id) for r in neardup.classes(docs).collect())
    assert got == sorted([(1, 1), (2, 1), (2, 1), (3, 1), (-1, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8), (9, 9), (10, 10)])
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == [1, 4, 6, 7, 8, 9, 10]
    assert neardup.classes(none).count() == 0


def test_many_edits_of_one_text_are_one_class(spark):
    words = prose(3, 200).split()
    rows = [(i, " ".join(words[:i] + ["edit"] + words[i + 1 :]) if i else " ".join(words)) for i in range(60)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_repeated_paragraphs_carry_the_weight(spark):
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join([passage] * 100 + [f"x{r.random()}".replace(".", "") for _ in range(500)])) for i in range(16)]
    rows += [(100 + i, " ".join(f"y{i}n{k}" for k in range(600))) for i in range(8)]
    for pair in range(0, 16, 2):
        # Each pair has a passage of its own.
        rows[pair], rows[pair + 1] = ((i, t.replace("p", f"q{pair}p")) for i, t in rows[pair : pair + 2])
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 if i < 16 else i for i, _ in rows}


def test_pairs_within_a_large_group_that_shares_a_passage(spark):
    passage = " ".join(f"p{i}" for i in range(1000))
    own = lambda i, n: " ".join(f"o{i}n{k}" for k in range(n))
    rows = [(i, f"{passage} {own(i // 2, 6) if i < 120 else own(5000 + i, 6)} {own(1000 + i, 18)}") for i in range(400)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 if i < 120 else i for i, _ in rows}


def test_packing(docs, none):
    path = tokens.default_path()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    got = bestfit.pack(docs, size=64).collect()
    per = {}
    for r in got:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in per.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end = o + n
        assert end <= 64
    want = []
    for i, t in TEXTS:
        x = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(x) if len(x) <= 64 else len(x) % 64 or 64
        cuts = [(0, head)] + [(s, 64) for s in range(head, len(x), 64)]
        want += [(i or -1, k, s, n, zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x[s : s + n]))) for k, (s, n) in enumerate(cuts)]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len(per) <= -(-sum(w[3] for w in want) // 64) + 1
    assert bestfit.pack(none).count() == 0


def test_plan_places_each_slot_once():
    counts = {1: 7, 3: 5, 5: 9, 7: 4, 10: 2}
    used = {}
    for length, slot, n, first, per, at in bestfit.plan(counts, 10):
        for s in range(n):
            for x in range(at + s % per * length, at + s % per * length + length):
                assert used.setdefault((first + s // per, x), (length, slot + s)) == (length, slot + s)
    assert len(used) == sum(k * v for k, v in counts.items())


def test_matrices_round_trip(spark, docs, none, tmp_path):
    packed.write_packed(packed.pack_matrices(docs, size=64), str(tmp_path / "m"))
    m = packed.read_packed(spark, str(tmp_path / "m"))
    assert all(len(r.ids) == 128 and r.position_resets == r.cu_seqlens[:-1] and r.cu_seqlens[-1] == r.n_tokens for r in m.collect())
    back = {}
    for r in packed.segments(m).collect():
        back.setdefault(r.doc_id, {})[r.start] = bytes(r.piece_ids)
    enc = tokens.encoder(tokens.default_path())
    for i, t in TEXTS:
        if i != 2:
            assert b"".join(v for _, v in sorted(back[i].items())) == tokens.ids(enc, t or "").astype("<u2").tobytes()
    assert packed.pack_matrices(none).count() == 0
    tree = packed.CapacityTree(10)
    tree.add(4, 1)
    tree.add(8, 1)
    assert [tree.least(k) for k in (1, 4, 5, 9)] == [4, 4, 8, -1]


def test_matrices_are_the_same_however_the_input_is_split(docs):
    alike = lambda df: sorted((r.pool, r.sequence, bytes(r.ids), tuple(r.pieces)) for r in packed.pack_matrices(df, size=64, pool_tokens=1500).collect())
    once = docs.dropDuplicates(["doc_id", "text"])  # rows alike are dealt by their count in a batch
    one = alike(once.coalesce(1))
    assert len({r[0] for r in one}) > 1 and one == alike(once.repartition(5))


def test_media(spark, docs, none):
    for r in media.text_media(docs).collect():
        t = next((u or "").encode() for i, u in TEXTS if i == r.doc_id)
        p = t + bytes(max(1, -(-len(t) // 64)) * 64 - len(t))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.text_media(none).count() == 0
    wav = media.store_wav(b"abcd" * 16)
    rows = spark.createDataFrame([(bytearray(wav), "image/png"), (bytearray(b"BM junk " + wav), None), (None, "text/plain"), (bytearray(wav[:-1]), "audio/wav")], "blob binary, declared string")
    got = media.sniff(rows, "blob", "declared").collect()
    assert [(r.media_type, r.corrected, len(r.embedded)) for r in got] == [("audio/wav", True, 1), (None, False, 1), ("text/plain", False, 0), ("audio/wav", False, 0)]


def _crc(data: bytes, bits: int, poly: int) -> int:
    r = 0
    for byte in data:
        r ^= byte << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ (poly if r >> (bits - 1) else 0)) & ((1 << bits) - 1)
    return r


def _examples() -> dict[str, bytes]:
    """A small valid file of each format; some hold end marks within, or several parts."""
    import gzip
    import io
    import struct
    import zipfile

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def frame(number, samples):
        # One channel of 16 bits, a constant subframe.
        head = b"\xff\xf8\x69\x08" + bytes([number, samples - 1])
        head += bytes([_crc(head, 8, 0x07)]) + b"\x00" + struct.pack(">h", 77 * number)
        return head + struct.pack(">H", _crc(head, 16, 0x8005))

    info = struct.pack(">HH", 100, 100) + bytes(6) + ((44100 << 44) | (15 << 36) | 250).to_bytes(8, "big") + bytes(16)
    flac = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame(0, 100) + frame(1, 100) + frame(2, 50)
    page = lambda flags, serial, body: b"OggS\x00" + bytes([flags]) + bytes(8) + struct.pack("<I", serial) + bytes(8) + bytes([1, len(body)]) + body
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "text PK\x05\x06 within and more of it to come")
        f.writestr("b.txt", "more")
    body = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    once = body + b"xref\n0 1\ntrailer\n<<>>\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF"
    pdf = once + b"\n2 0 obj\n<<>>\nendobj\nxref\n0 1\nstartxref\n" + str(len(once) + 21).encode() + b"\n%%EOF"
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", 2 + len(body)) + body
    webp = b"WEBP" + b"VP8 " + struct.pack("<I", 4) + b"abcd"
    return {
        "png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"IEND") + chunk(b"IEND", b""),
        "gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"!\xf9\x04;;;;\x00" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00;",
        "jpeg": b"\xff\xd8" + segment(0xE0, b"JFIF\xff\xd9\x00") + segment(0xDA, b"ab") + b"xx\xff\x00yy\xff\xd1zz" + segment(0xC4, b"\xff\xd9") + segment(0xDA, b"cd") + b"ww\xff\xd9",
        "bmp": media.store_bmp(b"abcd" * 16), "wav": media.store_wav(b"fLaC" * 16), "webp": b"RIFF" + struct.pack("<I", len(webp)) + webp, "au": media.store_au(b"PK\x03\x04" * 16),
        "flac": flac, "ogg": page(2, 1, b"a") + page(2, 2, b"b") + page(4, 1, b"c") + page(4, 2, b"OggS"), "pdf": pdf, "zip": z.getvalue(), "gzip": gzip.compress(b"many words " * 9),
        "mp4": box(b"ftyp", b"isom" + bytes(4)) + box(b"moov", b"") + struct.pack(">I4sQ", 1, b"mdat", 20) + b"data",
    }


def test_each_format_is_found_at_its_length():
    files = _examples()
    assert set(files) == set(media.TYPES)
    for order in (sorted(files), sorted(files, reverse=True)):
        blob, want = b"", []
        for kind in order:
            blob += b"\r\n- part of it \r\n"
            want.append((kind, len(blob), len(files[kind])))
            blob += files[kind]
        assert media.carve(blob) == want and media.carve(blob + b"--end--") == want
    for kind, file in files.items():
        assert media.carve(file) == [(kind, 0, len(file))]
        assert not any(found == (kind, 0, len(file)) for found in media.carve(file[:-1]))
    assert media.carve(b"%PDF-1 fLaC\x00 PK\x03\x04 \xff\xd8\xff BM GIF89a ftyp OggS \x1f\x8b\x08 RIFF .snd" * 50) == []


def test_pii(spark, none):
    texts = ["mail a.b@x.example.com now +1 (974) 555-3436 or 10.0.0.1 and 300.1.1.1", None, "", "card 4111 1111 1111 1111 and 4111111111111112", "x@y", "+1 (843) 555-7672 170.106.47.218"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found] == [(1, 1, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 0), (0, 1, 0, 0)]
    assert found[0].base_sha256 == hashlib.sha256(b"email:5:22,phone:27:44,ip:48:56").hexdigest()
    assert "<email>" in found[0].redacted
    assert pii.find(none).count() == 0


LOOSE = [
    ("mail {} today", "jane.doe @ mail.example.org", "email"), ("write to {} please", "bob(at)site.example.com", "email"), ("call {} now", "(020) 7946 0958", "phone"),
    ("call {} or", "974-555-3436", "phone"), ("pay {} soon", "4111.1111.1111.1111", "card"), ("see 7536784127813051 {} there", "4845168114407329", "card"), ("host {} is", "97[.]51[.]17[.]173", "ip"),
]


def test_tagger_adds_loose_forms_and_nothing_else(spark):
    """Learning from a corpus's own base matches, the tagger finds most loose writings; plain numbers and words stay clean."""
    corpus = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    filler = "und hewh that onereer " * 40
    planted = [(10**6 + i, filler + form.format(x) + " " + filler) for i, (form, x, _) in enumerate(LOOSE)]
    clean = [(2 * 10**6 + i, f"{filler} in {1990 + i} some {i} of {i * 731} and the 7536784127813051 {filler}") for i in range(20)]
    extra = [(3 * 10**6, None), (3 * 10**6 + 1, ""), (3 * 10**6 + 2, "12 " * 20_000 + "call 974-555-3436 or")]
    rows = spark.createDataFrame(planted + clean + extra + planted[:1], "doc_id long, text string")
    found = pii.find(corpus.unionByName(rows)).where("doc_id >= 1000000").collect()
    assert len(found) == len(planted) + len(clean) + len(extra) + 1
    by_id = {r.doc_id: r for r in found}
    hits = sum(by_id[i].spans == f"{k}:{t.index(x)}:{t.index(x) + len(x)}" for (i, t), (_, x, k) in zip(planted, LOOSE))
    assert hits >= len(LOOSE) - 1
    assert not any(by_id[i].spans for i, _ in clean + extra[:2])
    assert {r.spans for r in found if r.doc_id == 10**6} == {by_id[10**6].spans}


def test_windows_are_reconciled_as_one_path(spark):
    import numpy as np

    m = pii.Tagger.new()
    texts = ["a1b2 " * 30, "no trigger", "x@y " + "z" * 90 + " 5"]
    seen = {(i, start): tags for i, start, tags in pii._paths(texts, m)}
    for (i, start), tags in seen.items():
        starts = [s for s in pii.windows(texts[i]) if start <= s < start + len(tags)]
        total, weight = np.zeros((len(tags) + pii.WIDTH, pii.TAGS)), np.zeros((len(tags) + pii.WIDTH, 1))
        for s in starts:
            total[s - start : s - start + pii.WIDTH] += m.emissions(pii.encode([texts[i][s : s + pii.WIDTH]]))[0][0] * pii._DEPTH[:, None]
            weight[s - start : s - start + pii.WIDTH, 0] += pii._DEPTH
        em = (total / np.maximum(weight, 1))[: len(tags)]
        score = lambda path: em[range(len(path)), path].sum() + m.p[9][path[:-1], path[1:]].sum()  # noqa: E731, B023
        best = score(tags)
        r = np.random.default_rng(0)
        for _ in range(300):
            other = tags.copy()
            other[r.integers(0, len(tags), 2)] = r.integers(0, pii.TAGS, 2)
            assert score(other) <= best + 1e-9
    assert len(seen) >= 2 and not any(i == 1 for i, _ in seen)


def test_tagger_gradient():
    import numpy as np

    m = pii.Tagger.new(4, 3)
    x, y = pii.encode(["a@b.c 1", "+12"]), np.zeros((2, pii.WIDTH), int)
    y[0, :5] = 1
    _, grads = m.gradients(x, y)
    for k in (0, 1, 5, 7, 9):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old, e = m.p[k][at], 1e-5
        m.p[k][at] = old + e
        up = m.gradients(x, y)[0]
        m.p[k][at] = old - e
        down = m.gradients(x, y)[0]
        m.p[k][at] = old
        assert abs((up - down) / (2 * e) - grads[k][at]) < 1e-4 * max(1, abs(grads[k][at]))


def test_label_model_discounts_copies():
    import numpy as np

    r = np.random.default_rng(0)
    y = (r.random(4000) < 0.2).astype(float)
    a, b = ((r.random(4000) < 0.02 + 0.6 * y).astype(float) for _ in range(2))
    v = np.column_stack([a, a, b])
    m = toxicity.label_model(len(v), v.T @ v, v, y)
    assert m.on[0] < 0.8 * m.on[2]


def _held_out(spark, name: str, label: str, sf: str) -> tuple[float, float, float, float]:
    """Accuracy, precision, recall and area under the curve on held-out labels."""
    from quillmill.llm import queries

    got = queries.QUERIES[name](spark, sf).cache()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", label).dropna().collect()
    yes, no = ([r.score for r in rows if r[label] == k] for k in (1, 0))
    hits = sum(r.predicted == r[label] == 1 for r in rows)
    area = sum((y > x) + 0.5 * (y == x) for y in yes for x in no) / (len(yes) * len(no))
    return sum(r.predicted == r[label] for r in rows) / len(rows), hits / max(1, sum(r.predicted for r in rows)), hits / len(yes), area


def test_quality_on_held_out_rows(spark):
    accuracy, _, recall, area = _held_out(spark, "op6_quality", "quality", "/root/testdata/sf0.01")
    assert accuracy > 0.95 and recall > 0.95 and area > 0.95


def test_toxicity_on_held_out_rows(spark):
    """An eighth of these rows is toxic; some of them hold no toxic word, so no text model finds all."""
    _, precision, recall, area = _held_out(spark, "op4_toxicity", "toxic", "/root/testdata/sf0.1")
    assert precision > 0.85 and recall > 0.75 and area > 0.9


def test_scores_of_odd_rows(spark, docs, none):
    from quillmill.llm import quality

    sf = "/root/testdata/sf0.001"
    for module in (quality, toxicity):
        model = module.fit(spark, sf, docs)
        got = module.score(docs, model).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert {r.n_words for r in got} == {"x"} and len({r.score for r in got if r.text == BASE}) == 1
        assert len({r.score for r in got if not r.text}) == 1
        assert module.score(none, model).count() == 0
        assert module.score(docs, module.fit(spark, sf, none)).count() == len(TEXTS)


def test_best_fit_decreasing_against_brute_force():
    r = random.Random(2)
    for _ in range(200):
        size = r.choice((8, 20))
        lengths = [r.randrange(1, size + 1) for _ in range(r.randrange(40))]
        open_, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [k for k, room in enumerate(open_) if room >= lengths[i]]
            if fits:
                k = min(fits, key=lambda k: open_[k])
            else:
                k = len(open_)
                open_.append(size)
                want.append(0)
            open_[k] -= lengths[i]
            want[k] += lengths[i]
        got = packed.best_fit(lengths, size)
        assert sorted(i for seq in got for i in seq) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in seq) for seq in got) == sorted(want)


def test_ids_that_do_not_fit_are_refused(docs):
    with pytest.raises(Exception, match="needs more than 1 bytes"):
        packed.pack_matrices(docs, size=64, width=1).count()


def test_lines_of_one_polynomial_stay_apart(spark):
    """Thue-Morse sequences of two words and their complements agree in every polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = (" ".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    frame = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.dedup_lines(frame).collect()}
    assert got == {1: (0, one), 2: (0, other), 3: (1, "")}


def test_pii_long_runs_of_digits():
    import time

    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 5006, "ip")]
    began = time.time()
    run = "7" * 1_000_000
    assert pii.base_spans(f"{run} {run}.1.1.1 {'+1' * 200_000}") == []
    assert time.time() - began < 20


def test_pii_base_spans_on_random_texts():
    """The patterns as they are stated, tried at each place."""
    stated = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = random.Random(11)
    for _ in range(3000):
        text = "".join(r.choice(["0", "1", "25", "4111 1111 1111 1111", ".", ".", "@", "a", "-", " ", "+", "(", "é", "x@y.z"]) for _ in range(r.randrange(1, 30)))
        want = sorted(((m.start(), m.end(), k) for k, p in stated.items() for m in re.finditer(p, text) if pii.valid(k, m.group())), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert pii.base_spans(text) == want


def test_filters_are_bounded():
    from quillmill.llm.common import filter_bits

    assert all(p <= 20 and p + 7 <= b <= 27 for p, b in map(filter_bits, (0, 1, 100, 10**4, 10**6, 10**8)))


def test_pools_beyond_the_tasks_follow_each_other(docs):
    rows = lambda df: sorted((r.pool, r.sequence, bytes(r.ids), tuple(r.pieces)) for r in df.collect())
    one, many = (rows(packed.pack_matrices(docs, size=64, pool_tokens=300, tasks=t)) for t in (1, 10_000))
    assert one == many and len({r[0] for r in one}) > 5
    assert len({r[:2] for r in one}) == len(one)


def test_classes_against_all_pairs(spark):
    """Components of all pairs of weighted Jaccard 0.8 or more, over the documents of the smallest tables and edits of them."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(12)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for i, (_, text) in enumerate(rows[:60]):
        words = (text or "").split(" ")
        for k in range(2):
            edited = [w for w in words if r.random() > (0.01, 0.03)[k]]
            rows.append((10_000 + 2 * i + k, " ".join(edited)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    idf = neardup.idf_table(frame.withColumn("text", F.coalesce("text", F.lit(""))))
    s = neardup.Shingles(pa.array([t or "" for _, t in rows]), idf)
    own = [dict(zip(s.gram[s.row == i].tolist(), s.weight[s.row == i].tolist())) for i in range(len(rows))]
    total = [sum(x.values()) for x in own]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if min(total[i], total[j]) >= 0.79 * max(total[i], total[j]):
                common = sum(min(w, own[j][g]) for g, w in own[i].items() if g in own[j])
                if common >= 0.8 * (total[i] + total[j] - common) - 1e-9 or not total[i] + total[j]:
                    a, b = sorted((root(i), root(j)))
                    label[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    want = {d: least[root(i)] for i, (d, _) in enumerate(rows)}
    got = {x.doc_id: x.class_id for x in neardup.classes(frame).collect()}
    wrong = [d for d in want if got[d] != want[d]]
    assert not wrong and len(set(want.values())) < len(rows) - 60, np.array(wrong)


def test_agreement_sums_all_texts_however_they_are_split(spark):
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    lexicon = toxicity.Lexicon(np.array([toxicity._word_hash(x) for x in toxicity.INSULTS], np.uint64))
    width = len(lexicon.hashes) + toxicity.PATTERNS
    model = toxicity.Model(lexicon, np.zeros(width), 0.0)
    texts = [" ".join(r.choice(toxicity.INSULTS + WORDS[:40]) for _ in range(r.randrange(30))) for _ in range(300)]
    texts += texts[:40] + [None, "", "!!! SHUT UP !!!", "fool fool fool " * 2000]
    v = model.inputs(pa.array([t or "" for t in texts]))
    once = {t or "": row.astype(int).tolist() for t, row in zip(texts, v)}
    for parts in (1, 7):
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        n, counts, others = toxicity.agreement(df, spark.sparkContext.broadcast(model), width, 1 << 40)
        assert n == len(texts) and (counts == v.T @ v).all()
        assert sorted(x.tolist() for _, x in others) == sorted(once.values())
        few = toxicity.agreement(df, spark.sparkContext.broadcast(model), width, 16)[2]
        assert [slot for slot, _ in few] == list(range(16)) and all(x.tolist() in once.values() for _, x in few)
    n, counts, others = toxicity.agreement(df.where("false"), spark.sparkContext.broadcast(model), width, 16)
    assert n == 0 and not counts.any() and others == []


def test_labelled_rows_are_those_of_least_hash(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillmill.llm.common import held_out, labelled

    rows = [(i % 3000, float(i % 2)) for i in range(3500)] + [(7, 1.0)] * 500 + [(None, 1.0), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, toxic double")
    df.write.parquet(f"{tmp_path}/labels.parquet")
    usable = df.dropna().where(~held_out(F.col("doc_id"))).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").collect()
    for most in (1, 50, 2000, 100_000):
        got = labelled(spark, str(tmp_path), "toxic", most).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in usable[:most]]
