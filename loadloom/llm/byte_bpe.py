"""Ids of a byte-level BPE vocabulary.

Where the vocabulary numbers its merges in their order, the rank coder of tiktoken, built from the
same file, gives the ids of the tokenizers library several times faster; any other vocabulary,
and any text that holds the string of a special token, goes to that library.
"""

from __future__ import annotations

import functools
import json

import numpy as np

#: Fixed value: the pattern by which byte-level vocabularies of this kind split texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as printable characters."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def rank_coder(spec: dict):
    """A function from a text to an array of ids, or None where ranks can't stand for the merges."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    first = len(model["vocab"]) - len(merges)
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or model.get("end_of_word_suffix"):
        return None
    if any(model["vocab"].get(a + b) != first + k for k, (a, b) in enumerate(merges)):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    table = byte_of_char()
    ranks = {bytes(table[c] for c in token): i for token, i in model["vocab"].items()}
    return tiktoken.Encoding("chunks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy


class Encoder:
    """Texts to ids in little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.ranks = rank_coder(spec)

    @functools.cached_property
    def tokenizer(self):
        """The library's own coder, loaded where a text needs it."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def one(self, text: str) -> bytes:
        if not self.ranks or any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranks(text).astype("<u4", copy=False).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) if t else b"" for t in texts]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    return Encoder(path)
