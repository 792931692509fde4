import json
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakelore.llm import bpe, dac, packing
from lakelore.llm.words import WordEncoder

PARTS = [*"abcXYZ '09²½ªßÀéÿŁɏ.,!|#$\n\t\x0b\x1c\x1f\x85\xa0İı ​漢字Σσς́😀<|>\x00\xad·×÷", "<|endoftext|>", "<|startoftext|>", "<|endof", "'S", "'ll", "Ǆ", "  ", "the", "ing", "aaaa"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_words_are_the_librarys(vocab):
    with open(vocab("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    ours, library = WordEncoder(text, keep=500), Tokenizer.from_str(text)
    for t in texts(8000):
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_prefix_bpe_is_the_librarys(vocab):
    with open(vocab("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    ours, library = bpe.PrefixBpe(text, keep=500), Tokenizer.from_str(text)
    rng = random.Random(2)
    some = texts(6000) + ["".join(rng.choice("abehtinors") for _ in range(40)) for _ in range(1500)] + ["".join(rng.choice("aA=-_ ") for _ in range(60)) for _ in range(800)] + ["a" * 20000]
    for t in some:
        ids = library.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids, repr(t)[:100]
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_token_of_the_vocabulary(vocab):
    with open(vocab("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    ours, library = bpe.PrefixBpe(text), Tokenizer.from_str(text)
    for i in range(0, 50256, 7):
        t = library.decode([i])
        assert ours.encode(t) == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_dac_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 1 << 20, n).astype("u4")
    ids[: n // 3] %= 256
    firsts = np.array([0, n // 2, n // 2, n])
    f = dac.DacFile(dac.pack(ids, [5, None, -7], firsts))
    assert f.doc_ids == [5, None, -7] and f.stretch(0, n).tolist() == ids.tolist()
    assert [f.document(k).tolist() for k in range(3)] == [ids[: n // 2].tolist(), [], ids[n // 2 :].tolist()]
    for i in range(0, n, 37):
        assert f.token(i) == ids[i]
        assert f.stretch(i, min(n, i + 9)).tolist() == ids[i : i + 9].tolist()
    with pytest.raises(IndexError):
        f.token(n)


def test_token_files(spark, odd, none, vocab):
    path = vocab("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = sorted([(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()])
    got = dac.read(spark, dac.write(odd, path, ids_per_file=50), with_ids=True).orderBy("start").collect()
    start = 0
    for (known, doc_id, text), r in zip(rows, got, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id if known else None, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert dac.read(spark, dac.write(none, path)).count() == 0


def check_pieces(got, want, tokens, segments):
    """Every id once, sequences gapless and within limits."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
        total = sum(r.length for r in s)
        assert total == tokens or total < tokens and total & (total - 1) == 0
        assert len(s) <= segments
    for d, ids in want.items():
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        assert b"".join(bytes(p.ids) for p in pieces) == np.array(ids, "<u4").tobytes()
        assert all(p.ids_crc32 == zlib.crc32(bytes(p.ids)) and p.doc_tokens == len(ids) for p in pieces)
    return by_sequence


def test_packing(spark, odd, none, vocab):
    path = vocab("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = odd.dropDuplicates(["doc_id"])
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in rows.collect()}
    check_pieces(packing.pack(rows, path, with_ids=True).collect(), want, 4096, 64)
    check_pieces(packing.pack(rows, path, with_ids=True, tokens=64, segments=2, window=3).collect(), want, 64, 2)
    assert packing.pack(none, path).count() == 0


def test_packing_keeps_all_three_limits():
    rng = random.Random(3)
    p = packing.Packer(tokens=100, segments=3, loss=40, window=20)
    items = {k: (rng.randint(1, 250), rng.randint(0, 60)) for k in range(200)}
    out = [s for k, (n, f) in items.items() for s in p.add(k, n, f)] + p.end()
    seen = defaultdict(list)
    for s in out:
        assert len(s) <= 3 and sum(n for _, _, n in s) <= 100
        assert sum(max(0, at + n - max(at, items[k][1])) for k, at, n in s) <= 40
        for k, at, n in s:
            seen[k].append((at, n))
    for k, (n, _) in items.items():
        assert sorted(i for at, m in seen[k] for i in range(at, at + m)) == list(range(n))


def test_many_tiny_items_take_time_by_their_number():
    p = packing.Packer(loss=3840)
    began = time.perf_counter()
    out = [s for k in range(100_000) for s in p.add(k, 1)] + p.end()
    assert time.perf_counter() - began < 60 and len(p.waiting) == 0
    assert sum(len(s) for s in out) == 100_000 and max(map(len, out)) == 64


def test_loss_limit_binds(spark, vocab):
    """A limit below the tokens' is met by every sequence, and some are held back by it alone."""
    rows = spark.createDataFrame([(i, "one two three four\n" + "word " * (300 + i)) for i in range(40)], "doc_id long, text string").coalesce(1)
    docs = rows.select("doc_id", "text", packing.first_line(F.col("text")).alias("context"))
    loss = defaultdict(int)
    total = 0
    for r in packing.pack(docs, vocab("word_bpe_49k.json"), tokens=1024, loss=900, context="context").collect():
        loss[r.sequence_id] += r.loss_tokens
        total += r.loss_tokens
    assert max(loss.values()) == 900 and total == sum(301 + i for i in range(40))


def test_a_byte_that_the_vocabulary_lacks_is_an_error():
    spec = {"added_tokens": [], "model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}
    coder = bpe.PrefixBpe(json.dumps(spec))
    assert coder.encode("abab") == [2, 2]
    with pytest.raises(ValueError):
        coder.encode("abc")


def test_packing_wastes_nothing_on_mixed_lengths():
    rng = random.Random(4)
    p = packing.Packer()
    out = [s for k in range(3000) for s in p.add(k, rng.randint(1, 1500))] + p.end()
    assert sum(sum(n for _, _, n in s) == 4096 for s in out) / len(out) > 0.95


def test_bpe_operator(spark, odd, none, vocab):
    got = bpe.encode_and_decode(odd, vocab("byte_bpe_50k.json"))
    library = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    assert sorted([(r.text or "", r.ids) for r in got.collect()], key=repr) == sorted([(r.text or "", library.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()], key=repr)
    assert bpe.encode_and_decode(none, vocab("byte_bpe_50k.json")).count() == 0
