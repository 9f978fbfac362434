"""Token ids by a public tokenizer, word by word.

A tokenizer of words drops white space and never merges across it, so a text's ids are those of its
space-separated words, one after the other. Words repeat, so their ids are kept. Texts with
characters for which that isn't certain, and other tokenizers, go through the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import regex

#: Outside of these, normal forms, case or white space may differ between Python and the tokenizer.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa0-įı-ɏЀ-҂Ҋ-ԯ]|<\\|")
#: How the tokenizer of words (a fixed value of its file) splits a text.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Packed ids by lower-case word."""

    def __init__(self, model, dtype: str, most: int = 600_000):
        super().__init__()
        self._tokenize, self._type, self._most = model.tokenize, "H" if dtype == "<u2" else "I", most
        self._split, self._letters = regex.compile(_PIECES).findall, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self._most:
            self.clear()
        ids = []
        for piece in [word] if word.isalpha() else self._split(word):
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(self._letters)
            ids += [t.id for t in self._tokenize(piece)]
        packed = array(self._type, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        packed = packed.tobytes()
        if len(word) < 200:
            self[word] = packed
        return packed


class WordTokenizer:
    """``encode`` gives packed ids (``dtype``): those of ``tokenizers`` for the whole text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        steps = json.loads(self._tokenizer.to_str())["pre_tokenizer"] or {}
        by_word = [s.get("pattern", {}).get("Regex") for s in steps.get("pretokenizers", [])] == [_PIECES, None]
        self._words = _Words(self._tokenizer.model, self.dtype) if by_word else None

    def encode(self, text: str) -> bytes:
        if self._words is None or _ODD.search(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self._words.__getitem__, text.lower().split()))
