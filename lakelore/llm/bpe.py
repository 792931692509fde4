"""Operator 10: byte-level BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its BPE encoding. Candidates are
the vocabulary's tokens that are suffixes of the prefix (an Aho-Corasick automaton reports them);
token t of length n is the one iff (last token of the prefix n shorter, t) is a *compatible* pair: BPE
applied to the two tokens' bytes gives back just these two. The last tokens are stored per prefix and
back-pointers from the end give the ids. Time is linear in the piece for a bounded token length;
there is no quadratic merge loop, so a piece of a million letters is no trouble.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import filled, free_name, worker_memory
from .words import vocabulary

# Letters, numbers and white space below U+0250, and the vocabulary's splitting pattern.
_L, _N, _S = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_ANY = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile("[ɐ-\U0010ffff]")


class PrefixBpe:
    """A byte-level BPE vocabulary: ``encode`` and ``decode`` as the tokenizers library does."""

    def __init__(self, vocabulary: str, keep: int = 150_000):
        """vocabulary: the tokenizer's JSON text; keep: pieces whose ids are remembered."""
        import ahocorasick
        import regex

        spec = json.loads(vocabulary)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        raw = lambda token: bytes(byte[c] for c in token)
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: raw(t) for t, i in ids.items() if all(c in byte for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.halves: dict[int, tuple[int, int, int]] = {}  # token: its two halves and the merge's rank
        self.merged: dict[tuple[int, int], int] = {}  # pair: rank of its merge
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merged[ids[a], ids[b]] = rank
            self.halves[ids[a + b]] = (ids[a], ids[b], rank)
        self.single = {raw(t): i for t, i in ids.items() if len(t) == 1}
        self.compatible_: dict[tuple[int, int], bool] = {}
        # Latin-1 strings stand for bytes. A token that BPE never gives back for its own bytes can end no prefix.
        self.automaton = ahocorasick.Automaton()
        special = set(self.special.values())
        for i, b in self.bytes_of.items():
            if i not in special and (len(b) == 1 or i in self.halves) and self._reachable(i):
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.any = regex.compile(_ANY)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.keep = keep

    def _reachable(self, token: int) -> bool:
        half = self.halves.get(token)
        return half is None or self.compatible(half[0], half[1], half[2])

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether BPE leaves the boundary between two tokens alone (below: before the merge of that rank).

        Both tokens are taken apart from the last merge to the first. At each step the two tokens that
        face the boundary existed together during a span of ranks; a merge of that very pair within the
        span would have crossed it.
        """
        until = len(self.merged) if below is None else below
        merged, halves = self.merged, self.halves
        while True:
            rank = merged.get((left, right))
            a, b = halves.get(left), halves.get(right)
            born_a, born_b = a[2] if a else -1, b[2] if b else -1
            if rank is not None and rank < until:
                return False
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                left, until = a[1], born_a
            else:  # of one rank, the left-hand pair is merged before the right-hand one
                right, until = b[0], born_b + 1

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode().decode("latin-1")
        last = [0] * len(data)  # the token that ends each prefix
        memory = self.compatible_
        sizes = [0] * len(data)
        at_end, found = -1, False
        for end, (size, token) in self.automaton.iter(data):  # longest suffix first
            if end == at_end and found:
                continue
            if end != at_end:
                at_end, found = end, False
            start = end - size
            if start >= 0:
                pair = (last[start], token)
                good = memory.get(pair)
                if good is None:
                    if len(memory) > 300_000:
                        memory.clear()
                    good = memory[pair] = self.compatible(*pair)
                if not good:
                    continue
            last[end], sizes[end], found = token, size, True
        if not all(sizes):
            raise ValueError("the vocabulary has no token for a byte of the text")
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= sizes[at]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; strings of special tokens become those tokens, as in the library."""
        out: list[int] = []
        known = self.pieces
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in (self.any if _BEYOND.search(part) else _LATIN).findall(part):
                got = known.get(piece)
                if got is None:
                    got = self._piece(piece)
                    if len(piece) < 64:
                        if len(known) >= self.keep:
                            known.clear()
                        known[piece] = got
                out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def coder(shared, memory: dict) -> PrefixBpe:
    """The worker's coder for a broadcast vocabulary; kept in ``memory`` (see worker_memory) from task to task."""
    text = shared.value
    key = hash(text)
    if key not in memory:
        memory.clear()
        memory[key] = PrefixBpe(text)
    return memory[key]


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` with columns ids (array of int), n_tokens, ids_sha256 and decoded_sha256.

    Null and empty texts give no ids. One pass, no shuffle; every row is on its own, so a lost task is
    just run again. Columns of ``docs`` with the new names are replaced, others pass through whatever their names; keep_ids=False
    leaves out ids and the text. Repeated rows stay, an empty table gives no rows, and time grows with a text's length. A text
    with a byte that the vocabulary lacks is an error.
    """
    import hashlib

    shared = vocabulary(docs.sparkSession, path)
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if keep_ids else {})
    kept = [c for c in docs.columns if c not in new and (keep_ids or c != text)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], filled(F.col(f"`{text}`")).alias(free_name(docs, "__text")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32())}

        def out(batch, rows):
            return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(rows[c], types[c]) for c in new], names=kept + list(new))

        with worker_memory("bpe") as memory:
            bpe = coder(shared, memory)
            for batch in batches:
                rows, began, held = {c: [] for c in types}, 0, 0
                for i, t in enumerate(batch.column(len(kept))):
                    ids = bpe.encode(t.as_py())
                    rows["n_tokens"].append(len(ids))
                    rows["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        rows["ids"].append(ids)
                        held += len(ids)
                    if held > 500_000:  # a batch of bounded size, however long its texts
                        yield out(batch.slice(began, i + 1 - began), rows)
                        rows, began, held = {c: [] for c in types}, i + 1, 0
                if began < batch.num_rows:
                    yield out(batch.slice(began), rows)

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {k}" for c, k in new.items()])
    return source.mapInArrow(run, schema)
