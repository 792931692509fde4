"""Operator 1: quality and toxicity by hierarchical empirical Bayes.

A document classifier gives the probabilities that a text is of low quality or toxic. Sites add their evidence: the
rate of a host is shrunk toward the global rate, the rate of a path on it toward the host's, each by a prior whose
strength is fitted to how far rates differ between hosts, or between a host's paths (method of moments). A document's
posterior odds are its own evidence times the prior odds of its path, where the document itself is left out; a site with
few documents thus says little.

The classifier: logistic regression on traits that differ most between the classes: words, their beginnings and their
shapes (as hashes), by presence and by rate, and how often a word repeats the one before. It is trained with at most
``sample`` labelled rows, a documented bound: their traits are counted on Spark, and the driver gets the numbers of the chosen
traits only. Every document is scored on its whole text, and every rate counts all documents.
Texts don't travel: scoring is one pass, and only its numbers are grouped, summed up before the shuffle. Hosts and paths have one
row each, so a host with a third of all rows is no burden.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, identified, if_few, join_one, settle, worker_memory
from .hashing import BLOCK, ODD, between, blocks, edges, stretches, sums

#: The trait of a word that repeats the one before.
REPEATS = np.uint64(1)
#: A rate of this share of words counts in full.
FULL_RATE = 0.02
TARGETS = ("low", "toxic")

#: What a byte is in a word's shape: a lower-case letter or a byte beyond ASCII, an upper-case letter, a digit, or itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91], _SHAPE[48:58] = 65, 57
_LETTER = (_SHAPE == 97) | (_SHAPE == 65)


def _of_block(codes: np.ndarray, lower: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Traits of the words of a block, and their number."""
    starts, ends = edges(codes)
    if not len(starts):
        return [], 0
    whole = stretches(codes, starts, ends)
    found = [np.full(int((whole[1:] == whole[:-1]).sum()), REPEATS)]
    # Shapes: a run of bytes of one kind counts once.
    shape = _SHAPE[codes]
    turn = np.concatenate([[True], shape[1:] != shape[:-1]])
    turn[starts] = True
    before = np.concatenate([[0], np.cumsum(turn)])
    found.append(stretches(shape[turn], before[starts], before[ends]) ^ ODD[0])
    # Letters: all of a word's, and the first 3, 4 and 5 of longer ones.
    letter = _LETTER[codes]
    before = np.concatenate([[0], np.cumsum(letter)])
    first, last, letters = before[starts], before[ends], sums(lower[letter])
    some = last > first
    found.append(between(letters, first[some], last[some]) ^ ODD[1])
    for n in (3, 4, 5):
        longer = first[last - first > n]
        found.append(between(letters, longer, longer + n) ^ ODD[3])
    return found, len(starts)


def counts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Traits of a whole text in ascending order, how often it has each, and its number of words.

    A word longer than a block (256 kB) counts as several.
    """
    found, words = [], 0
    for block in blocks(text.encode("utf-8", "surrogatepass")):
        for at in range(0, len(block), 2 * BLOCK):
            some = block[at : at + 2 * BLOCK]
            more, n = _of_block(np.frombuffer(some, np.uint8), np.frombuffer(some.lower(), np.uint8))
            found += more
            words += n
    traits, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
    return traits, n, words


def rates(n: np.ndarray, words: int) -> np.ndarray:
    return np.minimum(1.0, n / max(1, words) / FULL_RATE)


@dataclass
class Model:
    """Traits that are looked at, in order; for each target its base rate, offset, and weights of presence and of rate."""

    traits: np.ndarray
    targets: dict[str, tuple[float, float, np.ndarray, np.ndarray]]


def chosen_rates(traits: np.ndarray, text: str) -> tuple[np.ndarray, int]:
    """A text's rate of each of ``traits`` (in order), and its number of words."""
    found, n, words = counts(text)
    out = np.zeros(len(traits))
    if len(traits) and len(found):
        at = np.minimum(np.searchsorted(traits, found), len(traits) - 1)
        known = traits[at] == found
        out[at[known]] = rates(n[known], words)
    return out, words


def probabilities(model: Model, text: str) -> list[float]:
    """For each target; a text without a word has the base rate."""
    rate, words = chosen_rates(model.traits, text)
    out = []
    for k in TARGETS:
        base, offset, presence, weight = model.targets[k]
        total = offset + presence @ (rate > 0) + weight @ rate if words else math.log(base / (1 - base))
        out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, total)))))
    return out


def train(rate: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """A target's part of the model. rate: rows x traits; y: 1 or 0 for each row; use: which traits it may weigh."""
    n, positive = len(y), float(y.sum())
    base = (positive + 0.5) / (n + 1)
    none = np.zeros(rate.shape[1])
    if not 0 < positive < n or not use.any():
        return base, math.log(base / (1 - base)), none, none
    x = np.concatenate([rate[:, use] > 0, rate[:, use]], 1).astype(float)
    w, offset = np.zeros(x.shape[1]), math.log(base / (1 - base))
    speed, power = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, 301):  # Adam on the whole sample, penalised by 1e-4 |w|^2
        q = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        g = np.append(x.T @ (q - y) / n + 1e-4 * w, (q - y).mean())
        speed, power = 0.9 * speed + 0.1 * g, 0.99 * power + 0.01 * g * g
        move = 0.1 * speed / (1 - 0.9**step) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
        w, offset = w - move[:-1], offset - move[-1]
    presence, weight = none.copy(), none.copy()
    presence[use], weight[use] = np.split(w, 2)
    return base, float(offset), presence, weight


def _sample(rows: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, low, toxic of at most ``sample`` labelled rows, spread by a hash; a repeated doc_id makes it no larger."""
    usable = labels.where("doc_id is not null and quality is not null and toxic is not null")
    usable = usable.select("doc_id", (1 - F.col("quality")).cast("int").alias("low"), F.col("toxic").cast("int").alias("toxic"))
    some = usable.orderBy(F.xxhash64("doc_id", F.lit("labels")), "doc_id", "low", "toxic").limit(sample)  # some kB: a row is three numbers
    named = rows.where("text is not null").select("__row", "doc_id").join(F.broadcast(some), "doc_id").select("__row", "low", "toxic")
    named = named.orderBy(F.xxhash64("__row", F.lit("rows")), "__row", "low", "toxic").limit(sample)
    return rows.select("__row", "text").join(F.broadcast(named), "__row").select("text", "low", "toxic")


def fit(rows: DataFrame, labels: DataFrame, sample: int = 2500, keep: int = 200, least: float = 4.5, seen: int = 5) -> Model:
    """Train on at most ``sample`` labelled rows of ``rows`` (__row, doc_id, text). Labels with nulls, and ones without a document, are left out.

    For each target, the ``keep`` traits whose mean presence or rate differs most between its classes (by ``least`` standard
    errors or more, in ``seen`` texts or more) are weighed.
    """
    work = Scratch(rows.sparkSession)
    known = work.settle(_sample(rows, labels, sample))

    def traits_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with worker_memory("quality"):
            for batch in batches:
                for t, low, toxic in zip(*batch.columns, strict=True):
                    traits, n, words = counts(t.as_py())
                    same = lambda v, k: pa.array(np.full(k, v.as_py(), np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(traits.view(np.int64)), pa.array(rates(n, words)), same(low, len(n)), same(toxic, len(n))], names=["trait", "rate", *TARGETS])

    size = {k: int(v or 0) for k, v in known.agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in TARGETS]).first().asDict().items()}
    each = known.mapInArrow(traits_of, "trait long, rate double, low int, toxic int")
    each = work.settle(
        each.groupBy("trait")
        .agg(F.count("*").alias("n"), F.sum("rate").alias("r"), F.sum(F.col("rate") ** 2).alias("rr"), *[F.sum(F.col(k) * v).alias(f"{k}_{x}") for k in TARGETS for x, v in (("n", F.lit(1)), ("r", F.col("rate")))])
        .where(F.col("n") >= seen)
    )
    weighed: dict[str, list[int]] = {}
    for k in TARGETS:
        total, positive = size["n"], size[k]
        if not 0 < positive < total:
            weighed[k] = []
            continue

        def apart(all_: Column, square: Column, ours: Column, total=total, positive=positive) -> Column:
            variance = F.greatest(square / total - (all_ / total) ** 2, F.lit(1e-9))
            return F.abs(ours / positive - (all_ - ours) / (total - positive)) / F.sqrt(variance * (1 / positive + 1 / (total - positive)))

        z = F.greatest(apart(F.col("n"), F.col("n"), F.col(f"{k}_n")), apart(F.col("r"), F.col("rr"), F.col(f"{k}_r")))
        best = each.select("trait", F.round(z, 6).alias("z")).where(F.col("z") >= least).orderBy(F.desc("z"), "trait").limit(keep)
        weighed[k] = [r[0] for r in best.collect()]
    traits = np.unique(np.array(sorted({t for v in weighed.values() for t in v}), np.int64).view(np.uint64))

    def matrix(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with worker_memory("quality"):
            for batch in batches:
                found = [chosen_rates(traits, t.as_py())[0].tobytes() for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], names=["rate", *TARGETS])

    rows_ = sorted((bytes(r.rate), r.low, r.toxic) for r in known.mapInArrow(matrix, "rate binary, low int, toxic int").collect())  # sample x keep numbers
    work.drop()
    rate = np.array([np.frombuffer(r[0]) for r in rows_]).reshape(len(rows_), len(traits))
    targets = {k: train(rate, np.array([float(r[1 + i]) for r in rows_]), np.isin(traits, np.array(weighed[k], np.int64).view(np.uint64))) for i, k in enumerate(TARGETS)}
    return Model(traits, targets)


def score(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` without its text, with p_low and p_toxic: the classifier's probabilities. No word: the base rates."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few hundred traits
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with worker_memory("quality"):
            model = shared.value
            for batch in batches:
                found = [probabilities(model, t.as_py() or "") for t in batch.column(len(kept))]
                more = [pa.array([x[i] for x in found], pa.float64()) for i in range(len(TARGETS))]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + more, names=kept + [f"p_{k}" for k in TARGETS])

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"p_{k} double" for k in TARGETS])
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)


def site(url: Column) -> tuple[Column, Column]:
    """(host, first part of the path) of a URL; null if it has none. ``www.`` in front says nothing about a host."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1))
    part = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)
    return F.nullif(found, F.lit("")), F.nullif(part, F.lit(""))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _strength(mean: float, spread: float) -> float:
    """Of a Beta prior with that mean and variance between groups: its weight in documents, 1 to 1000; 1000 if groups don't differ."""
    return min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0) if spread > 0 else 1000.0


def posteriors(scored: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """``scored`` with low and toxic: p_low and p_toxic combined with their host and path. Null hosts and paths are sites of their own."""
    each = {f"{x}_{k}": f(F.col(f"p_{k}")) for k in TARGETS for x, f in (("sum", F.sum), ("square", lambda c: F.sum(c * c)))}
    paths = settle(scored.groupBy(host, path).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in each.items()]))
    hosts = paths.groupBy(host).agg(F.sum("n").alias("host_n"), *[F.sum(n).alias(f"host_{n}") for n in each])

    def spread(groups: DataFrame, n: str, prefix: str) -> dict:
        """Global rate and the variance of group rates beyond what sampling makes: one row, of sums."""
        some = []
        for k in TARGETS:
            s, q = F.col(f"{prefix}sum_{k}"), F.col(f"{prefix}square_{k}")
            within = F.greatest(q / F.col(n) - (s / F.col(n)) ** 2, F.lit(0.0)) / F.col(n)
            some += [
                (F.sum(s) / F.sum(n)).alias(f"mean_{k}"),
                (F.sum(s * s / F.col(n)) / F.sum(n) - (F.sum(s) / F.sum(n)) ** 2 - F.sum(within * F.col(n)) / F.sum(n)).alias(f"spread_{k}"),
            ]
        row = groups.agg(*some).first()
        return {k: (row[f"mean_{k}"] or 0.0, max(row[f"spread_{k}"] or 0.0, 0.0)) for k in TARGETS}

    between = spread(hosts, "host_n", "host_")
    among = spread(paths, "n", "")
    sites = paths.join(hosts.withColumnRenamed(host, "__host"), F.col(host).eqNullSafe(F.col("__host"))).drop("__host")
    keys = {"__no_host": F.col(host).isNull(), "__host": F.coalesce(F.col(host).cast("string"), F.lit("")), "__no_path": F.col(path).isNull(), "__path": F.coalesce(F.col(path).cast("string"), F.lit(""))}
    sites = settle(sites.select(*[c.alias(n) for n, c in keys.items()], "n", F.col("n").alias("rows"), "host_n", *[f"{x}_{k}" for k in TARGETS for x in ("sum", "host_sum")]))
    few = if_few(sites, 12)
    # Few sites are broadcast; of many, those that hold much of the rows, and the others are dealt by key.
    out = scored.withColumns(keys)
    out = join_one(out, sites, list(keys), "rows") if few is sites else out.join(few.drop("rows"), list(keys))
    for k in TARGETS:
        mean, variance = between[k]
        by_host, by_path = _strength(mean, variance), _strength(mean, max(among[k][1] - variance, 0.0))
        p = F.col(f"p_{k}")
        rate = (F.col(f"host_sum_{k}") - p + by_host * mean) / (F.col("host_n") - 1 + by_host)
        prior = (F.col(f"sum_{k}") - p + by_path * rate) / (F.col("n") - 1 + by_path)
        odds = _logit(p) - _logit(F.lit(mean)) + _logit(prior)
        out = out.withColumn(k, F.round(1 / (1 + F.exp(-odds)), 6)).withColumn(f"site_{k}", F.round(prior, 6))
    return out.drop(*keys, "n", "host_n", *[f"{x}_{k}" for k in TARGETS for x in ("sum", "host_sum")])


def classify(
    docs: DataFrame, labels: DataFrame, sample: int = 2500, threshold: float = 0.5, host: str = "source", path: str = "lang", url: str | None = None, row: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, p_low, p_toxic, site_low, site_toxic, low, toxic, kept, and ``row`` if it is given.

    ``host`` and ``path`` name the columns of a document's site; where documents have addresses, ``url`` names their column and
    both come from it. kept is false where low or toxic is above ``threshold``. Null and empty texts are judged by their site
    alone; an empty table gives no rows; repeated rows, and rows of one doc_id, count each; very long texts are read in
    blocks; other columns don't matter, whatever their names. Without labels the classifier says nothing and all are kept.
    ``row`` names a column made by with_row_id().
    """
    at = site(F.col(f"`{url}`")) if url else (F.col(f"`{host}`"), F.col(f"`{path}`"))
    rows = identified(docs, {"doc_id": F.col("doc_id"), "host": at[0], "path": at[1], "text": F.coalesce("text", F.lit(""))}, row)
    found = posteriors(settle(score(rows, fit(rows, labels, sample))))
    out = found.withColumn("kept", (F.col("low") <= threshold) & (F.col("toxic") <= threshold)).drop("host", "path")
    return out.withColumnRenamed("__row", row) if row else out.drop("__row")
