"""Operator 7: Jaccard self-join on word 5-grams, rare-first, and the components of its links.

A document's set: its distinct 5-word shingles, each a token of 63 bits: how rare it is (5 bits), then 58 bits of hash. Tokens in
order are thus rare first, the one order that all sets share. Rarity is estimated by a table of 2**23 counters over all
documents, a fixed size that is merged in a tree; any order is right, a better one only saves candidates. Sets with the same
128-bit digest are one node; copies join no pair. Two sets with Jaccard similarity t or more share a token among the first few
of each (the prefix); rare ones first, few sets share one.

Candidates share a prefix token and pass the length and the positional filter within the join. Each pair then meets once with
its two sets and passes the suffix filter: what stands behind the prefix is parted by a middle token of one set, again and
again, and the sizes of the parts bound how many tokens must differ. Only what is left is intersected. To keep a large group
of near copies from making a pair of each two, pairs are tried in two steps that lose no link between components:

1. In each token's group, each set with the first one of its size class, and that one with the first of the class below: no
   more pairs than rows. First is where fewest rarer tokens stand before it: in a family of copies with changes of their
   own, that is the one they were all made from.
2. In groups that still span several components, the sets outside the group's largest component with those sets of other
   components whose size class is the same or next. Pairs within a component are left out: their link would join nothing.

Groups of frequent tokens are summed up, never gathered: their rows meet only in joins with one row per key on the other side
(step 1), or in joins that Spark splits (step 2). Rows of a rare token, of which there are few, are dealt by token once. Sets are made again from the texts of those pairs only; a list of them is broadcast to the
scan if it is counted and short, else joined.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, filled, identified, if_few, join_one, settle, worker_memory
from .components import components
from .hashing import ODD, mixed, word_hashes

COUNTERS, SLOTS = 1 << 23, 64
#: Bits of a token's hash, and how many classes of rarity stand above them.
_HASH_BITS, _CLASSES = 58, 32

def shingles(text: str, n: int = 5) -> np.ndarray:
    """The set of a text, ascending: 58-bit hashes of n words in a row; of all words if they are fewer; none without words.

    bytes.lower() lowers A-Z only; words end at the six ASCII white-space characters only.
    """
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return np.zeros(0, np.uint64)
    width = min(n, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total * ODD[0] + h[i : len(h) - width + 1 + i] * ODD[1 + i % 4])
    return np.unique(total >> np.uint64(64 - _HASH_BITS))


def _digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def classes_of(counters: np.ndarray) -> np.ndarray:
    """A class of rarity for each counter: two for each doubling."""
    return np.minimum(_CLASSES - 1, 2 * np.log2(counters.astype(np.float32) + 1)).astype(np.uint8)


def tokens(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set of shingles as tokens in their order, rare first."""
    rarity = classes[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort(rarity << np.uint64(_HASH_BITS) | s)


def least_common(n: int, m: int, percent: int) -> int:
    """How many tokens sets of n and m must share."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Sets that link share a token among so many first ones of a set of n."""
    return n - -(-percent * n // 100) + 1


def differing(x: np.ndarray, y: np.ndarray, most: int, depth: int = 4) -> int:
    """Suffix filter: a lower bound of how many tokens stand in one of two ordered sets only; beyond ``most`` it may stop early.

    The middle token of y parts both sets; tokens of one part can only be shared with the same part of the other.
    """
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    here = at < len(x) and x[at] == y[middle]
    behind_x, behind_y = x[at + here :], y[middle + 1 :]
    alone, behind = int(not here), abs(len(behind_x) - len(behind_y))
    if alone + abs(at - middle) + behind > most:
        return alone + abs(at - middle) + behind
    before = differing(x[:at], y[:middle], most - alone - behind, depth - 1)
    if alone + before + behind > most:
        return alone + before + behind
    return alone + before + differing(behind_x, behind_y, most - alone - before, depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ordered sets link: suffix filter behind their first common token, then their intersection."""
    need = least_common(len(x), len(y), percent)
    a, b = x[: prefix_length(len(x), percent)], y[: prefix_length(len(y), percent)]
    both = a[np.isin(a, b, assume_unique=True)]
    if not len(both):
        return False
    i, j = int(np.searchsorted(x, both[0])), int(np.searchsorted(y, both[0]))
    # What stands before the first common token is not shared (a token before it that were is before it in the other too).
    most = len(x) + len(y) - 2 * need
    if i + j + differing(x[i + 1 :], y[j + 1 :], most - i - j) > most:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _profile(rows: DataFrame) -> DataFrame:
    """Per document __row, n, id (digest) and short (64 bits of it); and per task the counters, in slots. One pass over the texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["file", "row", "n", "id", "short", "part", "slot", "counts"]
        with worker_memory("ngram_join"):
            counters = np.zeros(COUNTERS, np.uint32)
            for batch in batches:
                out = []
                for f, r, t in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                    s = shingles(t.as_py())
                    digest = _digest(s)
                    np.add.at(counters, (s & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
                    out.append((f.as_py(), r.as_py(), len(s), digest, _short(digest), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)
            part = TaskContext.get().partitionId()
            for i, b in enumerate(counters.reshape(SLOTS, -1)):
                if b.any():
                    block = (None, None, None, None, None, part, i, zlib.compress(b.tobytes(), 1))
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(block, kinds, strict=True)], names=names)

    return rows.select("__row.file", "__row.row", "text").mapInArrow(run, "file long, row long, n long, id binary, short long, part long, slot long, counts binary")


def _rarity(blocks: DataFrame, work: Scratch, fan: int = 256) -> np.ndarray:
    """A class of rarity for each counter, from the sum of all tasks' counters, held at 2**32 - 1. At most ``fan`` blocks of a slot
    meet in one group, in as many rounds as that takes; the driver gets 8 MB at any size of the corpus."""

    def add(some):
        import pyarrow as pa

        total = np.zeros(COUNTERS // SLOTS, np.uint32)
        for c in some.column("counts"):
            more = np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
            total = np.where(total > np.uint32(2**32 - 1) - more, np.uint32(2**32 - 1), total + more)
        return pa.table({"part": some.column("part")[:1], "slot": some.column("slot")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    def classed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [classes_of(np.frombuffer(zlib.decompress(c.as_py()), np.uint32)).tobytes() for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["slot", "classes"])

    tasks = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        blocks = work.settle(blocks.withColumn("part", F.floor(F.col("part") / fan)).groupBy("slot", "part").applyInArrow(add, "part long, slot long, counts binary"))
        tasks = -(-tasks // fan)
        if tasks <= 1:
            break
    found = np.zeros((SLOTS, COUNTERS // SLOTS), np.uint8)
    for r in blocks.select("slot", "counts").mapInArrow(classed, "slot long, classes binary").toLocalIterator():
        found[r.slot] = np.frombuffer(r.classes, np.uint8)
    return found.reshape(-1)


def _prefixes(rows: DataFrame, shared, percent: int) -> DataFrame:
    """token, short, n, pos of each set's prefix, rare tokens first; a set that a task has had lately is left out."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["token", "short", "n", "pos"])

        with worker_memory("ngram_join"):
            classes, had = shared.value, set()
            found, held = [[], [], [], []], 0
            for batch in batches:
                for t in batch.column(0):
                    s = shingles(t.as_py())
                    short = _short(_digest(s))
                    if not len(s) or short in had:
                        continue
                    if len(had) >= 100_000:  # what is forgotten comes again and is dropped later
                        had.clear()
                    had.add(short)
                    first = prefix_length(len(s), percent)
                    values = tokens(s, classes)[:first].view(np.int64), np.full(first, short, np.int64), np.full(first, len(s), np.int32), np.arange(first, dtype=np.int32)
                    for x, v in zip(found, values, strict=True):
                        x.append(v)
                    held += first
                    if held > 200_000:
                        yield out()
                        found, held = [[], [], [], []], 0
            if held:
                yield out()

    return rows.select("text").mapInArrow(run, "token long, short long, n int, pos int")


#: The class of rarity of tokens that may be in any number of sets. Those of a class below are in fewer than 2**15.5, as counters never fall short.
_OFTEN = _CLASSES - 1


def _met(prefixes: DataFrame, classes: np.ndarray, work: Scratch) -> DataFrame:
    """Rows of ``prefixes``, each once, whose token another set has too.

    Tokens of a class below the last are in few sets at any size of the corpus: their rows travel once, by token, and are told apart
    where they meet. Those of the last class are counted first and go through join_one, as their groups may be large.
    """
    own = Window.partitionBy("token")
    met = lambda rows: rows.withColumns({"__a": F.min("short").over(own), "__b": F.max("short").over(own)}).where("__a <> __b").drop("__a", "__b").distinct()
    if not (classes >= _OFTEN).any():
        return met(prefixes)
    prefixes = work.settle(prefixes)
    often = F.shiftright("token", _HASH_BITS) >= _OFTEN
    many = prefixes.where(often)
    several = many.groupBy("token").agg(F.min("short").alias("a"), F.max("short").alias("b"), F.count("*").alias("sets")).where("a <> b").select("token", "sets")
    return met(prefixes.where(~often)).unionByName(join_one(many, work.settle(several), ["token"], "sets").distinct())


#: Bytes of sets in a batch that a task sends on.
_BATCH = 8 << 20


def _sets(rows: DataFrame, chosen: DataFrame, shared) -> DataFrame:
    """id, copies and set (tokens in order) of the rows named in ``chosen`` (__row, id, copies)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(copies, pa.int64()), pa.array(sets, pa.binary())], names=["id", "copies", "set"])

        with worker_memory("ngram_join"):
            classes, ids, copies, sets, held = shared.value, [], [], [], 0
            for batch in batches:
                for i, c, t in zip(*batch.columns, strict=True):
                    ids.append(i.as_py())
                    copies.append(c.as_py())
                    sets.append(tokens(shingles(t.as_py()), classes).tobytes())
                    held += len(sets[-1])
                    if held > _BATCH:
                        yield out()
                        ids, copies, sets, held = [], [], [], 0
            if ids:
                yield out()

    return rows.select("__row", "text").join(if_few(chosen), "__row").select("id", "copies", "text").mapInArrow(run, "id binary, copies long, set binary")


#: Pairs of a set, about, that meet one copy of it.
_PAIRS_A_COPY = 64


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int, shared, work: Scratch) -> DataFrame:
    """Links a, b (digests) among candidate pairs x, y of shorts, each looked at once.

    Of a pair, ``a`` is the end with fewer pairs, so none of P pairs' ends is ``a`` more than sqrt(2 P) times: its set goes beside each
    of them. The set of ``b``, which may be in most pairs, is copied once for every few of them, and these are dealt by copy.
    """

    def same(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with worker_memory("ngram_join"):
            for batch in batches:
                good = [linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(batch.column(2), batch.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    degrees = pairs.select(F.explode(F.array("x", "y")).alias("short")).groupBy("short").agg(F.count("*").alias("n"))
    ends = work.settle(nodes.select("short", "id").join(degrees, "short").select("short", "id", "n", F.struct("n", "id").alias("end")))
    side = lambda old: ends.select(F.col("short").alias(old), F.col("end").alias(f"{old}_end"), "n")
    met = join_one(join_one(pairs, side("x"), ["x"]), side("y"), ["y"])
    both = work.settle(met.select(F.least("x_end", "y_end")["id"].alias("a"), F.greatest("x_end", "y_end")["id"].alias("b")))
    hubs = work.settle(both.groupBy("b").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / _PAIRS_A_COPY)))
    both = work.settle(join_one(both, hubs, ["b"]).select("a", "b", F.pmod(F.xxhash64("a"), "copies").alias("copy")))
    wanted = both.select(F.col("a").alias("id"), F.lit(0).cast("long").alias("copies")).union(hubs.select("b", "copies")).groupBy("id").agg(F.max("copies").alias("copies"))
    sets = work.settle(_sets(rows, work.settle(nodes.select("__row", "id").join(wanted, "id")), shared))
    left = if_few(both, 4).join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    of_hubs = sets.where("copies > 0").select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("set").alias("set_b"))
    return work.settle(left.join(of_hubs, ["b", "copy"]).select("a", "b", "set_a", "set_b").mapInArrow(same, "a binary, b binary"))


def _may_link(small: str, large: str, percent: int) -> Column:
    """Length and positional filter, n of ``small`` being at most that of ``large``."""
    n, m, p, q = F.col(f"{small}n"), F.col(f"{large}n"), F.col(f"{small}pos"), F.col(f"{large}pos")
    need = (100 + percent) * (1 + F.least(n - p - 1, m - q - 1)) >= percent * (n + m)
    return (100 * n >= percent * m) & need


def _first_pairs(live: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """Step 1: pairs x, y (shorts) of each set with the first of its token and size class, and of firsts of neighbouring classes."""
    groups = live.groupBy("token", "size").agg(F.min(F.struct("pos", "short", "n")).alias("f"), F.count("*").alias("sets"))
    firsts = work.settle(groups.select("token", "size", "sets", *[F.col(f"f.{c}").alias(f"f_{c}") for c in ("short", "n", "pos")]))
    to_first = join_one(live, firsts, ["token", "size"], "sets").select(*[c for x in ("", "f_") for c in (f"{x}short", f"{x}n", f"{x}pos")])
    below = firsts.select("token", (F.col("size") + 1).alias("size"), *[F.col(f"f_{c}").alias(c) for c in ("short", "n", "pos")])
    ladder = firsts.join(below, ["token", "size"]).select(*to_first.columns)
    met = to_first.unionByName(ladder).where("short <> f_short")
    fits = ((F.col("n") <= F.col("f_n")) & _may_link("", "f_", percent)) | ((F.col("n") > F.col("f_n")) & _may_link("f_", "", percent))
    return work.settle(met.where(fits).select(F.least("short", "f_short").alias("x"), F.greatest("short", "f_short").alias("y")).distinct())


def _left_pairs(live: DataFrame, root: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """Step 2: pairs x, y of sets of different components (root; null: unknown) that share a prefix token and may link."""
    rooted = work.settle(live.join(root, "short"))
    groups = rooted.groupBy("token", "root").agg(F.count("*").alias("sets")).groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("sets", "root")).alias("largest"), F.sum("sets").alias("sets"))
    several = work.settle(groups.where("parts > 1 or largest.root is null").select("token", F.col("largest.root").alias("main"), "sets"))
    spread = work.settle(join_one(rooted, several, ["token"], "sets"))
    rename = lambda d, p, size: d.select("token", size.alias("size"), *[F.col(c).alias(p + c) for c in ("short", "n", "pos", "root")])
    classes = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
    outside = rename(spread.where("not (root <=> main) or root is null"), "x_", classes)
    met = outside.join(rename(spread, "y_", F.col("size")), ["token", "size"]).where("x_short <> y_short and (x_root <> y_root or x_root is null or y_root is null)")

    def indexed(s: str) -> Column:
        """The smaller one's shorter prefix is enough."""
        n, share = F.col(f"{s}n"), Fraction(2 * percent, 100 + percent)
        return F.col(f"{s}pos") < n - F.ceil(n * share.numerator / share.denominator - 1e-9) + 1

    up = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_short") < F.col("y_short")))
    good = (up & _may_link("x_", "y_", percent) & indexed("x_")) | (~up & _may_link("y_", "x_", percent) & indexed("y_"))
    return met.where(good).select(F.least("x_short", "y_short").alias("x"), F.greatest("x_short", "y_short").alias("y")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, stays (once per component), and ``row`` if it is given.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets; component_id is the least doc_id
    reachable by links, itself included. A null or empty text, or one of white space only, has an empty set and is linked
    with nothing; null doc_ids count last, so a component has one only if all its doc_ids are null. Repeated rows are
    copies, and one of them stays; very long texts are hashed in blocks; an empty table gives no rows; other columns don't
    matter, whatever their names. ``row`` names a column made by with_row_id().
    """
    rows = identified(docs, {"doc_id": F.col(f"`{doc_id}`"), "text": filled(F.col(f"`{text}`"))}, row)
    work = Scratch(docs.sparkSession)
    profile = work.settle(_profile(rows))
    classes = _rarity(profile.where("counts is not null").select("part", "slot", "counts"), work)
    shared = work.broadcast(classes)
    each = profile.where("file is not null").select(F.struct("file", "row").alias("__row"), "n", "id", "short")
    named = each.where("n > 0").groupBy("short", "id").agg(F.min("__row").alias("__row"))
    nodes = work.settle(named)

    # Prefixes whose token another set has too. A class is a little wider than what may link, so classes of linked sets are neighbours.
    size = F.floor(F.log("n") / F.lit(math.log(100 / percent * 1.000001))).cast("long")
    live = work.settle(_met(_prefixes(rows, shared, percent), classes, work).withColumn("size", size))

    tried = _first_pairs(live, percent, work)
    links = _links(tried, nodes, rows, percent, shared, work)

    same = nodes.groupBy("short").agg(F.min("id").alias("id"), F.max("id").alias("most"))
    roots = components(links)
    root = same.join(roots, same["id"] == roots["node"], "left").select("short", F.when(F.col("id") == F.col("most"), F.coalesce("root", "id")).alias("root"))
    more = work.settle(_left_pairs(live, root, percent, work).join(tried, ["x", "y"], "left_anti"))
    links = links.unionByName(_links(more, nodes, rows, percent, shared, work))

    # Components of sets, then the least doc_id of each.
    roots = components(links).select(F.col("node").alias("id"), "root")
    ids = rows.select("__row", "doc_id").join(each, "__row").join(roots, "id", "left")
    ids = settle(ids.select("__row", "doc_id", "n", F.coalesce("root", "id").alias("root")))
    work.drop()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row")))
    least = settle(ids.where("n > 0").groupBy("root").agg(best.alias("best"), F.count("*").alias("docs")))
    found = join_one(ids.where("n > 0"), least, ["root"], "docs")
    found = found.select("__row", "doc_id", "n", F.col("best.doc_id").alias("component_id"), (F.col("__row") == F.col("best.row")).alias("stays"))
    alone = ids.where("n = 0").select("__row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    out = found.unionByName(alone)
    return out.select(*([F.col("__row").alias(row)] if row else []), "doc_id", F.col("n").alias("n_shingles"), "component_id", "stays")
