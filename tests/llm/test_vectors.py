import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelore.llm import ball_tree, lattice, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def _table(n=300, width=16, seed=4, kinds=5):
    """Clustered vectors, some equal, some on a coarse grid so that distances tie."""
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(kinds)]
    rows = []
    for i in range(n):
        m = middles[i % kinds]
        v = [round(x + rng.gauss(0, 0.2), 1) if i % 3 else x for x in m]
        rows.append((n - i, v, i % 4 if i % 7 else None))
    return rows


def _odd(rows, width):
    v = rows[0][1]
    return rows + [(10_000, None, 1), (10_001, [None, *v[1:]], 1), (10_002, [math.nan, *v[1:]], 1), (10_003, [math.inf, *v[1:]], 1), (10_004, v[:-1], 1), (10_005, [], 1), (None, v, None), (rows[0][0], v, 2), (rows[0][0], v, 2)]


def _frame(spark, rows):
    """Spark's floats, so that the plain versions see the same numbers."""
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"n": F.lit(1), "slot": F.lit("x"), "code": F.lit(2), "key": F.lit(3), "cluster": F.lit(4)})
    return frame, [(r.vec_id, r.embedding, r.label) for r in frame.collect()]


def _sound(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def _near(x, book):
    return min(range(len(book)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(x, book[j], strict=True)), j))


def _lloyd(points, book, rounds):
    for _ in range(rounds):
        groups = {}
        for x in points:
            groups.setdefault(_near(x, book), []).append(x)
        book = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else b for j, b in enumerate(book)]
    return book, [_near(x, book) for x in points]


def _far(x, c):
    return sum((a - b) ** 2 for a, b in zip(x, c, strict=True))


def _sha(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def _codes(rows, width, parts, entries=16, rounds=6, scale=4096):
    kept = sorted([r for r in rows if _sound(r[1]) and len(r[1]) == width], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(x * scale) for x in v] for _, v, _ in kept]
    w = width // parts
    out, errors, all_books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        points = [q[p * w : p * w + w] for q in ints]
        book, near = _lloyd(points, points[:entries], rounds)
        all_books += [c for e in book for c in e]
        for k, j in enumerate(near):
            out[k] += f"{j:02x}"
            errors[k] += _far(points[k], book[j])
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted([(i, c, e, by_label[label], _sha(all_books)) for (i, _, label), c, e in zip(kept, out, errors, strict=True)], key=repr)


def _clusters(rows, width, clusters, rounds=5, scale=256):
    kept = sorted([r for r in rows if _sound(r[1]) and len(r[1]) == width], key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    ints = [[math.floor(x * scale) for x in v] for _, v, _ in kept]
    book, near = _lloyd(ints, ints[:clusters], rounds)
    far = [_far(x, book[j]) for x, j in zip(ints, near, strict=True)]
    return sorted([(i, j, d, sum(d for d, k in zip(far, near, strict=True) if k == j), sum(far), _sha(book[j])) for (i, _, _), j, d in zip(kept, near, far, strict=True)], key=repr)


@pytest.mark.parametrize("width", [8, 16])
def test_codes_are_those_of_full_scans(spark, width):
    frame, rows = _frame(spark, _odd(_table(width=width), width))
    got = vector_codes.compress(frame.repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == _codes(rows, width, 8)


def test_clusters_are_those_of_full_comparison(spark):
    frame, rows = _frame(spark, _odd(_table(400, 16, kinds=9), 16))
    got = ball_tree.cluster(frame.repartition(4), width=16, clusters=12, block=50, leaf=4)
    assert sorted(map(tuple, got.collect()), key=repr) == _clusters(rows, 16, 12)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    frame, rows = _frame(spark, _table(n, 8))
    assert sorted(map(tuple, vector_codes.compress(frame).collect()), key=repr) == _codes(rows, 8, 8)
    assert sorted(map(tuple, ball_tree.cluster(frame, width=8).collect()), key=repr) == _clusters(rows, 8, 40)
    nothing = frame.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert vector_codes.compress(nothing).count() == ball_tree.cluster(nothing).count() == 0


def test_odd_widths_and_sizes(spark):
    frame, _ = _frame(spark, _table(5, 9))
    with pytest.raises(ValueError):
        vector_codes.compress(frame)
    with pytest.raises(ValueError):
        vector_codes.compress(frame, entries=300)
    big = spark.createDataFrame([(1, [1e30] * 8, 1), (2, [0.0] * 8, 1)], VECTORS)
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(big).count()


def test_bounds_save_scans_and_change_nothing():
    """Rounds with bounds kept from one to the next against full scans, on numbers that tie often."""
    rng = np.random.default_rng(2)
    points = rng.integers(-4, 5, (600, 2, 3)) * rng.choice([1, 1, 50], (600, 1, 1))
    books = vector_codes.Codebooks.of(points[:9].transpose(1, 0, 2).copy())
    state, scans = None, []
    for _ in range(12):
        state = vector_codes.assign(points, books, state)
        scans.append(state.scanned)
        full = vector_codes.assign(points, books)
        assert (state.codes == full.codes).all()
        for p in range(2):
            d = ((points[:, p, None, :] - books.entries[p][None]) ** 2).sum(2)
            near = d[np.arange(600), state.codes[:, p]]
            assert (state.upper[:, p].astype(float) ** 2 >= near).all() and (full.codes[:, p] == d.argmin(1)).all()
            rest = d.astype(float)
            rest[np.arange(600), state.codes[:, p]] = np.inf
            assert (np.maximum(state.lower[:, p].astype(float), 0) ** 2 <= rest.min(1)).all()
        sums = {}
        for p in range(2):
            for s, (n, x) in lattice.partials(state.codes[:, p].astype(int) + p * 9, points[:, p]).items():
                sums[s] = (n, x.tolist())
        books = vector_codes.Codebooks.of(vector_codes._moved(books.entries, sums), books.entries)
    assert scans[0] == 1200 and scans[-1] < 600


@pytest.mark.parametrize("leaf", [1, 8])
def test_whole_balls_are_assigned(leaf):
    rng = np.random.default_rng(3)
    middles = rng.integers(-400, 400, (10, 6))
    points = middles[rng.integers(0, 10, 2000)] + rng.integers(-3, 4, (2000, 6))
    tree, order = ball_tree.build(points, leaf)
    assert (tree.points == points[order]).all() and sorted(order) == list(range(2000))
    for k, c in enumerate((middles, np.concatenate([middles, middles]), rng.integers(-400, 400, (15, 6)), middles[:1])):
        d = ((points[order][:, None] - c[None]) ** 2).sum(2)
        near, far = ball_tree.assigned(tree, c)
        assert (near == d.argmin(1)).all() and (far == d.min(1)).all()
        balls, compared, _ = ball_tree.filtered(tree, c)
        if k == 0:
            assert len(compared) < 200 and len(balls) < 200
        got = ball_tree.summed(tree, c)
        assert {s: (n, x.tolist()) for s, (n, x) in got.items()} == {s: (int((near == s).sum()), tree.points[near == s].sum(0).tolist()) for s in set(near.tolist())}


def test_sums_beyond_64_bits(spark):
    rows = spark.range(4).select(F.lit(3).alias("slot"), F.lit(2).cast("long").alias("n"), F.array(F.lit(2**62), F.lit(-1).cast("long")).alias("sums"))
    assert lattice.added(rows) == {3: (8, [2**64, -4])}


def test_large_integers_are_exact():
    points = np.array([[2**29, 0], [2**29 - 1, 1]])
    x, c = lattice.exact(points, points)
    assert x.dtype == np.int64 and lattice.squared(x, c).tolist() == [[0, 2], [2, 0]]


def test_codes_decode_near_their_vectors(spark):
    frame, _ = _frame(spark, _table(200, 16))
    found, books = vector_codes.codes(frame)
    near = vector_codes.decode(found, books).join(frame.select("vec_id", "embedding"), "vec_id").collect()
    assert max(max(abs(a - b) for a, b in zip(r.approximation, r.embedding, strict=True)) ** 2 for r in near) <= max(r.error for r in near) / 4096**2 + 0.01
