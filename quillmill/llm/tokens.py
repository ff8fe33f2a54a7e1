"""Token ids of a public byte-level BPE file, read once in each Python worker."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

END_ID = 2
#: Splits as the file's ByteLevel pre-tokenizer does; possessive runs only spare backtracking.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The JSON file's vocabulary; merges rank as their ids do in this family of files, and added tokens stay whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    return tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)


def ids(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The text's ids and the end id, as little-endian unsigned 32-bit numbers."""
    got = enc.encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)
    return np.append(got, np.uint32(END_ID)).astype("<u4")


def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole up to size, else pieces of size after a shorter first one."""
    head = n if n <= size else n % size or size
    return [(0, head)] + [(s, size) for s in range(head, n, size)]
