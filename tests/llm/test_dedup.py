import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lakelore.llm import common, components, exact_dedup, line_dedup, ngram_join, syncmers

SPACE = re.compile("[\x20\x09-\x0d]+")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


# ---- exact ----


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("bits", [64, 1])
def test_exact(spark, odd, none, bits):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 30))) for _ in range(150)] + [None, "ab" * 40, "ab " * 40, "ba" * 40]
    want = brute_exact(list(enumerate(texts)))
    got = exact_dedup.dedup(frame(spark, texts), block=4, hash_bits=bits).collect()
    assert len(got) == len(texts)
    for r in got:
        plain = SPACE.sub("", texts[r.doc_id] or "")
        assert (r.keep_id, r.group_size) == want[plain] and r.text_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert r.kept == (r.keep_id == r.doc_id)
    if bits == 64:
        found = exact_dedup.dedup(odd).collect()
        assert len(found) == 11 and sum(r.kept for r in found) == 7  # nothing (3), "one two three" (3) and five of their own
        assert exact_dedup.dedup(none).count() == 0


# ---- syncmers ----


def test_fingerprints(spark, none):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 5, 60, 300]))) for _ in range(40)] + [None]
    texts[7] = texts[3]
    got = {r.doc_id: r for r in syncmers.fingerprints(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if len(t) > 1500 and len(after) > 1500:
            assert got[i].near_edited > 0.15 > got[i].near_next
    assert got[3].fingerprint == got[7].fingerprint and got[40].fingerprint == ""
    assert syncmers.fingerprints(none).count() == 0


def test_next_document_over_many_stretches(spark):
    rows = spark.createDataFrame([(3 * i, str(i)) for i in range(101)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.next_text for r in syncmers.with_next(rows, ["text"], rows_each=7).collect()}
    assert got == {3 * i: str((i + 1) % 101) for i in range(101)}


def brute_anchors(spark, text, k=5, s=2):
    """{hash of a closed syncmer: its first place} of a text, from the hashes of its words' runs."""
    words = re.findall(r"[^\x20\x09-\x0d]{1,64}", text)
    runs = [words[i : i + s] for i in range(len(words))]
    inner = [r.h for r in spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, r array<string>").selectExpr("i", "xxhash64(r[0], get(r, 1)) as h").orderBy("i").collect()] if words else []
    found = {}
    for i in range(len(words) - k + 1):
        some = inner[i : i + k - s + 1]
        if min(some) in (some[0], some[-1]):
            found.setdefault(tuple(some), i)
    mask = (1 << 63 - syncmers._PLACE_BITS) - 1
    keys = list(found)
    hashes = [r[0] & mask for r in spark.createDataFrame([(i, *x) for i, x in enumerate(keys)], "i int, a long, b long, c long, d long").selectExpr("i", "xxhash64(a, b, c, d) as h").orderBy("i").select("h").collect()] if keys else []
    return dict(sorted((h, found[key]) for h, key in zip(hashes, keys, strict=True)))


def test_anchors_are_all_closed_syncmers(spark):
    rng = random.Random(21)
    text = " ".join(f"w{rng.randrange(40)}" for _ in range(900))
    df = spark.createDataFrame([(text,)], "text string")
    want = brute_anchors(spark, text)
    got = [(x >> syncmers._PLACE_BITS, x & ((1 << syncmers._PLACE_BITS) - 1)) for x in syncmers.with_anchors(df, "text", "a", share=1).first().a]
    assert got == list(want.items())
    some = syncmers.with_anchors(df, "text", "a").first().a  # one in four, of least hash
    assert [x >> syncmers._PLACE_BITS for x in some] == list(want)[: max(64, -(-len(want) // 4))]


def brute_likeness(a, b, least=64):
    """Of two anchor arrays: every pair of matches compared."""
    split = lambda x: {v >> syncmers._PLACE_BITS: v & ((1 << syncmers._PLACE_BITS) - 1) for v in x}
    a, b, sure = split(a), split(b), min(max(len(a), least), max(len(b), least))
    total = sorted({*a, *b})[:sure]
    if not total:
        return 1.0
    m = sorted((a[h], a[h] - b[h], h) for h in a if h in b and h <= total[-1])
    good = 0
    for i, (at, shift, _) in enumerate(m):
        near = [m[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(m)]
        follows = any(abs(shift - s) <= 1 + max(abs(at - p), abs(at - shift - p + s)) / 4 for p, s, _ in near)
        good += shift == 0 or follows or sum(s == shift for _, s, _ in m) > 1
    return good / len(total)


def test_likeness_is_the_plain_one(spark):
    rng = random.Random(22)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([0, 3, 8, 80, 700]))]
        other = list(words)
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.choice([0, 1, 1, 30])] = [f"n{rng.randrange(50)}"] * rng.randint(0, 2)
        if rng.random() < 0.3:
            other = other[len(other) // 2 :] + other[: len(other) // 2]
        rows.append((" ".join(words), " ".join(other)))
    df = spark.createDataFrame(rows, "text string, other string").repartition(3)
    df = syncmers.with_likeness(syncmers.with_anchors(syncmers.with_anchors(df, "text", "a"), "other", "b"), "a", "b", "near")
    for r in df.collect():
        assert abs(r.near - brute_likeness(r.a, r.b)) < 1e-12


def test_syncmers_are_context_free(spark):
    core = " ".join(f"c{i}" for i in range(40))
    df = spark.createDataFrame([(core,), ("x y z " + core + " q",)], "text string")
    a, b = (set(x >> syncmers._PLACE_BITS for x in r.a) for r in syncmers.with_anchors(df, "text", "a", share=1).collect())
    assert len(a) > 5 and a <= b


def test_short_texts_have_fingerprints(spark):
    rng = random.Random(11)
    texts = [" ".join(f"s{rng.randrange(1000)}" for _ in range(n)) for n in (1, 4, 5, 6, 7) for _ in range(30)]
    df = spark.createDataFrame([(t, "") for t in texts], "text string, other string")
    df = syncmers.with_anchors(syncmers.with_anchors(df, "text", "a"), "other", "b")
    got = syncmers.with_likeness(df, "a", "b", "near").collect()
    assert all(len(r.a) > 0 and r.near == 0 for r in got) and all(r.b == [] for r in got)


def test_likeness_of_long_texts_with_scattered_edits(spark):
    rng = random.Random(12)
    words = [f"l{i}" for i in range(20000)]
    edited, cut = list(words), list(words)
    for _ in range(300):
        edited.insert(rng.randrange(len(edited)), "new")
        del cut[rng.randrange(len(cut))]
    mixed = [words[i : i + 10] for i in range(0, len(words), 10)]
    rng.shuffle(mixed)
    texts = [" ".join(x) for x in (edited, cut, sum(mixed, []))]
    df = spark.createDataFrame([(" ".join(words), t) for t in texts], "text string, other string")
    df = syncmers.with_anchors(syncmers.with_anchors(df, "text", "a"), "other", "b")
    got = [r.near for r in syncmers.with_likeness(df, "a", "b", "near").collect()]
    share = [len({x >> syncmers._PLACE_BITS for x in r.a} & {x >> syncmers._PLACE_BITS for x in r.b}) / len(r.a) for r in df.collect()]
    assert min(got[:2]) > 0.75 and got[2] < 0.25 < share[2], (got, share)


def test_fingerprints_hold_all_syncmers(spark):
    rng = random.Random(31)
    words = [f"f{rng.randrange(4000)}" for _ in range(900)]
    texts = [" ".join(words)] + [" ".join([*words[:at], "new", *words[at + 1 :]]) for at in range(20, 880, 40)]
    got = {r.doc_id: r for r in syncmers.fingerprints(frame(spark, texts)).collect()}
    held = [[int(x, 16) for x in got[i].fingerprint.split(",")] for i in range(len(texts))]
    for i in (0, 1, 9):
        assert [(x >> syncmers._PLACE_BITS, x & ((1 << syncmers._PLACE_BITS) - 1)) for x in held[i]] == list(brute_anchors(spark, texts[i]).items())
    assert len({got[i].fingerprint for i in got}) == len(texts)  # one changed word, wherever it stands, shows
    for i in range(len(texts)):
        after, edited = held[(i + 1) % len(texts)], [int(x, 16) for x in got[i].edited_fingerprint.split(",")]
        assert got[i].near_next < 1 and abs(got[i].near_next - brute_likeness(held[i], after, 10**9)) < 1e-12
        assert abs(got[i].near_edited - brute_likeness(held[i], edited, 10**9)) < 1e-12


def test_odd_fingerprints(odd):
    assert syncmers.fingerprints(odd).count() == 11


# ---- lines ----


def brute_lines(rows, least):
    units = [[(p, x.strip(" \t\n\x0b\f\r")) for p, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\f\r")] for t in rows]
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0d]+", x))
    first, gone = {}, defaultdict(set)
    for d, lines in enumerate(units):
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(map(size, run)) >= least and (d, a) > first.setdefault(run, (d, a)):
                    gone[d] |= {p for p, _ in lines[a : b + 1]}
    return ["\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone[d]) if t is not None else None for d, t in enumerate(rows)]


def test_lines(spark, odd, none):
    rng = random.Random(7)
    lines = ["a b", "c", "d e f", " c ", "", "g h i j k l", "m"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, texts), min_words=6).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, 6)
    assert line_dedup.dedup_lines(odd).count() == 11 and line_dedup.dedup_lines(none).count() == 0


# ---- near ----


def brute_near(texts, percent):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    find = lambda a: a if root[a] == a else find(root[a])
    for a, x in enumerate(sets):
        for b in range(a):
            if x and 100 * len(x & sets[b]) >= percent * len(x | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [(len(x), find(i)) for i, x in enumerate(sets)]


def test_near(spark, odd, none):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 8, 30, 120]))] for _ in range(25)]
    texts = [None, "", "a b c", "A B  c"]
    for words in base:
        for _ in range(rng.randint(1, 7)):
            some = list(words)
            for _ in range(rng.randint(0, max(1, len(some) // 30))):
                some[rng.randrange(len(some))] = f"n{rng.randint(0, 99)}"
            texts.append(" ".join(some))
    # One large family, each a step away from the one before: its ends are linked only through the others.
    chain = [f"z{i}" for i in range(100)]
    for i in range(40):
        chain[2 * i] = f"y{i}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_near(texts, 80)
    stays = ngram_join.near_duplicates(odd)
    assert stays.count() == 11 and stays.where("stays").count() == 9
    assert ngram_join.near_duplicates(none).count() == 0


def test_suffix_filter_never_exceeds_the_difference():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 200, rng.integers(0, 80)).astype(np.uint64)) for _ in range(2))
        apart = len(np.setxor1d(x, y))
        for most in (0, 5, 1000):
            assert ngram_join.differing(x, y, most) <= apart or ngram_join.differing(x, y, most) > most >= 0 and apart > most
        for percent in (50, 80, 100):
            union = len(np.union1d(x, y))
            assert not len(x) or not len(y) or ngram_join.linked(x, y, percent) == (100 * (len(x) + len(y) - union) >= percent * union)


def test_templates_make_few_pairs(spark, monkeypatch):
    """Many components that share most of their shingles with others: what they share is common, so it is in no prefix."""
    tried = []
    links = ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda pairs, *a: (tried.append(pairs.count()), links(pairs, *a))[1])
    rng = random.Random(13)
    frame_ = [f"t{i}" for i in range(150)]
    texts = [" ".join(frame_[:75] + [f"d{i}x{j}" for j in range(60)] + frame_[75:]) for i in range(300)]
    texts += [t.replace("x5 ", "y5 ") for t in rng.sample(texts, 40)]
    got = ngram_join.near_duplicates(frame(spark, texts)).select("component_id").distinct().count()
    assert got == 300 and sum(tried) < 300, tried


def test_hot_keys_stay_where_they_are(spark):
    big = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as v")
    small = common.settle(big.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")))
    got = common.join_one(big, small, ["k"])
    assert sorted(map(tuple, got.select("k", "v", "least").collect())) == sorted((0 if i % 3 == 0 else i, i, 0 if i % 3 == 0 else i) for i in range(5000))


def test_names_do_not_depend_on_the_tasks(spark):
    texts = [f"{i % 70} some text" * 5 for i in range(200)]
    named = lambda n: sorted((r.doc_id, r.n_blocks, r.name) for r in exact_dedup.identities(common.identified(frame(spark, texts).repartition(n), {"doc_id": F.col("doc_id"), "text": F.col("text")}), block=16).collect())
    assert named(2) == named(7)


def test_lines_take_time_by_their_number(spark):
    text = "\n".join(f"line {i} of a long text with some words" for i in range(20_000))
    rows = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(rows).collect()}
    assert got[1].text == text and got[2].text == "" and got[2].removed_lines == 20_000


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_row_ids_are_stable(spark, odd):
    rows = common.with_row_id(odd, "at")
    assert sorted(map(str, rows.select("at").collect())) == sorted(map(str, rows.select("at", "text").select("at").collect()))
    assert rows.select("at").distinct().count() == 11
    with pytest.raises(ValueError):
        common.with_row_id(odd, "TEXT")
