"""Byte-level BPE ids of whole texts.

Texts are encoded by rank, which gives the same ids as the vocabulary's list of merges where the two
have one order; that is checked when a vocabulary is loaded. Nothing is kept between texts.
"""

from __future__ import annotations

import json
import sys
import types
from array import array

#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PART = 1 << 20  # characters encoded together


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def worker_state() -> dict:
    """A dictionary that outlives a task in a reused Python worker."""
    return sys.modules.setdefault("meridian_worker_state", types.ModuleType("meridian_worker_state")).__dict__


def byte_characters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


def byte_ranks(vocabulary: str) -> dict[bytes, int]:
    """Tokens of a vocabulary file as bytes, with their ids; an error where ids don't follow the merges or texts are changed before."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{vocabulary} is not a plain byte-level vocabulary")
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        raise ValueError(f"the ids of {vocabulary} don't follow its merges")
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    return {bytes(map(byte_of.__getitem__, token)): number for token, number in model["vocab"].items()}


class RankTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids. Control strings in a text are ordinary text."""

    def __init__(self, vocabulary: str):
        import tiktoken

        self.ids = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=byte_ranks(vocabulary), special_tokens={}).encode_ordinary

    @classmethod
    def shared(cls, vocabulary: str) -> RankTokenizer:
        """The worker's own one, made once."""
        state = worker_state()
        if (key := f"tokenizer {vocabulary}") not in state:
            state[key] = cls(vocabulary)
        return state[key]

    def encode(self, text: str) -> bytes:
        """A very long text is cut in front of blanks behind a non-space, where no piece of the pattern goes on."""
        if len(text) <= PART:
            return self._encode(text)
        parts, at = [], 0
        while at < len(text):
            cut = text.find(" ", at + PART)
            while cut > 0 and text[cut - 1].isspace():
                cut = text.find(" ", cut + 1)
            parts.append(self._encode(text[at:] if cut < 0 else text[at:cut]))
            at = len(text) if cut < 0 else cut
        return b"".join(parts)

    def _encode(self, text: str) -> bytes:
        found = array("I", self.ids(text))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()
