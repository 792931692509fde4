"""Ids of the word-level vocabulary, by the tokenizers library, with what repeats kept.

The library lower-cases a text, cuts it into pieces by its pattern (white space only separates
them) and runs its model on each piece. A text made only of characters below U+0250 (NFC changes
none of them, and lower-casing goes character by character) without the opening of a special token
is cut here by the same pattern, and each *new* piece goes to the library's model; any other text
goes to the library whole. So the ids are the library's for every text.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

# Letters, numbers and white space below U+0250, lower case.
_L, _N, _S = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
# Fixed value: the library's splitting pattern of this vocabulary.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Lower-casing U+0130 gives two characters, so it counts as unusual too.
_UNUSUAL = re.compile("[İɐ-\U0010ffff]|<\\|")


class _Pieces(dict):
    """Ids of each piece seen, as bytes; emptied at ``keep`` entries, so its size is bounded."""

    def __init__(self, model, keep: int):
        self.model, self.keep = model, keep
        # The library's byte-level alphabet: printable Latin-1 stands for itself, the rest for U+0100 on.
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}

    def __missing__(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.alphabet)
        ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(piece) <= 64:  # so what is kept is bounded in bytes too
            if len(self) >= self.keep:
                self.clear()
            self[piece] = ids
        return ids


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, vocabulary: str, keep: int = 400_000):
        """vocabulary: the tokenizer's JSON text, not a path, so executors need no file of their own."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.direct = all(t["content"].startswith("<|") for t in json.loads(vocabulary)["added_tokens"])
        self.pieces = _Pieces(self.library.model, keep)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if self.direct and not _UNUSUAL.search(text):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(shared, memory: dict) -> WordEncoder:
    """The worker's encoder for a broadcast vocabulary; kept in ``memory`` (see worker_memory) from task to task."""
    text = shared.value
    key = hash(text)
    if key not in memory:
        memory.clear()
        memory[key] = WordEncoder(text)
    return memory[key]


def vocabulary(spark, path: str):
    """The tokenizer's file, read on the driver and broadcast: a fixed size of a few MB."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
