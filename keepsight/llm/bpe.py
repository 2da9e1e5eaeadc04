"""Ids of a public byte-level BPE vocabulary, with a memory for pieces of text.

A text is cut at single spaces between visible characters. The vocabulary's own splitting
always ends a token there, so each piece's ids depend on the piece alone and a bounded
memory answers for the frequent ones.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s | \s|\A | \Z")


class Vocabulary:
    """``ranks``: a file of tokens and ids; ``pattern``: how text is split; ``special``: text to id."""

    def __init__(self, ranks: str, pattern: str, special: dict[str, int] | None = None, memory: int = 200_000):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._special = special or {}
        self._cut = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        self._known: dict[str, bytes] = {}
        self._memory = memory

    def _plain(self, text: str) -> bytes:
        return np.array(self._own.encode_ordinary(text), np.uint32).tobytes()

    def _pieces(self, text: str) -> bytes:
        head, *rest = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
        parts = list(map(self._known.get, rest))
        if None in parts:
            for k, part in enumerate(parts):
                if part is None:
                    parts[k] = self._plain(" " + rest[k])
                    if len(self._known) < self._memory and len(rest[k]) <= 64:
                        self._known[rest[k]] = parts[k]
        return b"".join([self._plain(head), *parts])

    def ids(self, text: str) -> np.ndarray:
        """Little-endian 32-bit ids of the whole text."""
        if not text:
            return np.zeros(0, np.uint32)
        if self._cut and any(s in text for s in self._special):
            parts = [
                np.uint32(self._special[t]).tobytes() if t in self._special else self._pieces(t)
                for t in self._cut.split(text)
                if t
            ]
            return np.frombuffer(b"".join(parts), np.uint32)
        return np.frombuffer(self._pieces(text), np.uint32)


def special_tokens(definition: str) -> dict[str, int]:
    """The special tokens that a tokenizer's definition file recognises in a text."""
    with open(definition, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", []) if t.get("special")}


@lru_cache(4)
def vocabulary(name: str, definition: str | None = None) -> Vocabulary:
    """A vocabulary of the installed public tokenizers, once for each worker process.

    With ``definition``, a tokenizer's own file, its special tokens are recognised.
    """
    import public_tokenizers

    special = special_tokens(public_tokenizers.path(definition)) if definition else {}
    return Vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN, special)
