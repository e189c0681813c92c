"""Ids of whole texts under a byte-level BPE vocabulary file, stretch by stretch.

Texts repeat their words, so the tokenizer is asked once for a stretch without
white space and the answers are joined. That equals encoding the whole text for
vocabularies whose pieces never reach over white space: ``WordBpe`` looks at the
file for the steps it knows and hands whole texts to the library otherwise.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np
from tokenizers import Tokenizer

# The steps before the merges under which stretches are independent.
STEPS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# Stretches that no normalisation but lower case changes, and the same pattern for them.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_LETTERS = re.compile("([a-zß-öø-ÿ]+)([^a-z0-9ß-öø-ÿ']*)")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# White space to str.split, but not to the pattern.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_characters() -> dict[int, str]:
    """The character a byte-level vocabulary writes for each byte.

    Printable bytes stand for themselves, the others for the characters from
    U+0100 on, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordBpe:
    """``encode(text)``: ids as little-endian unsigned 32-bit integers.

    At most ``limit`` stretches and parts are remembered at a time.
    """

    def __init__(self, vocabulary: str, limit: int = 500_000):
        spec = json.loads(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.by_stretch = all(spec[k] == v for k, v in STEPS.items()) and not spec["post_processor"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.limit = limit
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.merge = self.tokenizer.model.tokenize
        self.characters = byte_characters()
        outer = self

        class Stretches(dict):
            def __missing__(self, stretch):
                if len(self) >= outer.limit:
                    self.clear()
                ids = self[stretch] = outer._stretch(stretch)
                return ids

        class Parts(dict):
            def __missing__(self, part):
                if len(self) >= outer.limit:
                    self.clear()
                mapped = part if part.isascii() else "".join(map(outer.characters.__getitem__, part.encode()))
                ids = self[part] = _pack([t.id for t in outer.merge(mapped)])
                return ids

        self.stretches, self.parts = Stretches(), Parts()

    def _library(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _stretch(self, stretch: str) -> bytes:
        if not _PLAIN.fullmatch(stretch) or any(s in stretch for s in self.specials):
            return self._library(stretch)
        lowered = stretch.lower()
        if found := _LETTERS.fullmatch(lowered):  # nearly all: a word, signs after it or not
            word, signs = found.groups()
            return self.parts[word] + self.parts[signs] if signs else self.parts[word]
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(lowered)))

    def encode(self, text: str) -> bytes:
        if not self.by_stretch or _SEPARATORS.search(text):
            return self._library(text)
        return b"".join(map(self.stretches.__getitem__, text.split()))


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()
