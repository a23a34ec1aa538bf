"""Byte-level BPE ids of whole texts.

The ids are those of the tokenizers library for a vocabulary file of its own.
Its merges are in the order of the ids, so the same file also gives the ranks
for tiktoken, which encodes the same text several times faster. Which
characters are letters depends on a library's Unicode tables, so tiktoken gets
only texts whose characters are in a range on which all versions agree; any
other text, and one that holds a special token or a very long run of white
space, goes through the tokenizers library.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Characters on which all Unicode versions agree: ASCII without rare controls, Latin letters, common punctuation.
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧€]|\s{1000}")
#: The published splitting pattern of byte-level vocabularies; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_padding()
        self.library.no_truncation()
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        with open(vocabulary, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        chars = byte_of_char()
        ranks = {bytes(chars[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if UNUSUAL.search(text) or (self.special and self.special.search(text)):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()
