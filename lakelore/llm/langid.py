"""Operator 4: language identification by error-correcting output codes.

Each language has a codeword of bits; a binary classifier over letter n-grams of words predicts each bit. Decoding is
loss-weighted: a language's distance is the exponential loss of its codeword against the classifiers' margins, each
bit weighted by how well its classifier does on that language; the nearest codeword wins, and a runner-up almost as
near flags the text as ambiguous.

A text's features are the hashed n-grams (1 to 3 letters, with the word's ends) of its words, as shares of all, counted
over the whole text at once. Training takes a sample of bounded size per language (``per_lang``) and solves a ridge regression
in feature space: tasks sum the products of features, so the driver gets matrices of a fixed size, no texts and no rows.
Everything else goes over all rows in one pass without a shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .common import Scratch, if_few, settle, worker_memory

UNDETERMINED = "und"
#: Classes of hashed n-grams.
BUCKETS = 2048


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # n-gram buckets x bits
    offsets: np.ndarray  # bits
    trust: np.ndarray  # languages x bits


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords: all ways to part up to five languages in two, else the best of many random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1.0, *c] for c in itertools.product((-1.0, 1.0), repeat=n - 1) if min(c) < 0]).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    found = []
    for _ in range(300):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        found.append((apart.min(), -len(found), code[:, np.abs(code.sum(0)) < n]))
    return max(found, key=lambda x: x[:2])[2]


_LETTERS = None
#: Code points looked at in one go, so that a very long text takes no more memory than a long one.
BLOCK = 1 << 20


def counts(text: str, buckets: int) -> np.ndarray:
    """Numbers of a text's n-grams per bucket: 1 to 3 letters in a row, anything else being an end of a word; all zeros without a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate([np.zeros(1, np.uint32), np.where(_LETTERS[codes], codes, 0).astype(np.uint32), np.zeros(2, np.uint32)])
    total = np.zeros(buckets, np.int64)
    for at in range(0, len(codes) - 2, BLOCK):
        a, b, c = (codes[at + i : min(at + i + BLOCK, len(codes) - 2 + i)] for i in range(3))
        two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)
        three = two + c * np.uint32(0xC2B2AE35)
        for grams in (b[b != 0] * np.uint32(0x27D4EB2F), two[(a | b) != 0], three[b != 0]):
            grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount((grams ^ (grams >> np.uint32(12))) % np.uint32(buckets), minlength=buckets)
    return total


def margins(model: Model, text: str) -> np.ndarray | None:
    """The classifiers' margins, or None for a text without a letter."""
    found = counts(text, len(model.weights))
    n = found.sum()
    return (found @ model.weights) / n + model.offsets if n else None


def decode(model: Model, margin: np.ndarray) -> tuple[str, float, bool]:
    """(language, score from 0 to 1, whether the runner-up is almost as near)."""
    loss = (model.trust * np.exp(-np.clip(model.codes * margin, -4, 4))).sum(1)
    near = np.exp(-4 * (loss - loss.min()))
    share = near / near.sum()
    best = int(loss.argmin())
    rest = np.delete(share, best)
    return model.langs[best], float(share[best]), bool(len(rest) and rest.max() > 0.5 * share[best])


def features(text: str, buckets: int = BUCKETS) -> np.ndarray | None:
    """Shares of a text's n-grams, or None for a text without a letter."""
    x = counts(text, buckets)
    n = x.sum()
    return x / n if n else None


@dataclass
class Sums:
    """What rows teach, summed up: each language's rows and summed features, and products of features where a row weighs ``weight`` of its language."""

    rows: dict[str, int]
    features: dict[str, np.ndarray]
    products: np.ndarray  # buckets x buckets


def solve(sums: Sums, ridge: float = 1e-5) -> Model:
    """A model of which the trust is still 1 for all bits. Every language counts the same, whatever its number of rows."""
    langs = sorted(sums.rows)
    codes, buckets = codewords(len(langs)), len(sums.products)
    if not langs:
        return Model([], codes, np.zeros((buckets, 1)), np.zeros(1), np.zeros((0, 1)))
    of_lang = np.array([sums.features[k] / sums.rows[k] for k in langs])
    mean, level = of_lang.mean(0), codes.mean(0)
    left = sums.products / len(langs) - np.outer(mean, mean)
    left[np.diag_indices(buckets)] += ridge
    weights = np.linalg.solve(left, of_lang.T @ codes / len(langs) - np.outer(mean, level))
    return Model(langs, codes, weights.astype(np.float32), level - mean @ weights, np.ones_like(codes))


def trusted(model: Model, right: dict[str, np.ndarray]) -> Model:
    """The model, trusting each bit for each language as far as it was right. right: shares of rows by bit."""
    trust = np.array([right[k] for k in model.langs]).reshape(len(model.langs), -1) + 1e-3
    return Model(model.langs, model.codes, model.weights, model.offsets, trust / trust.sum(1, keepdims=True))


def train(rows: list[tuple[str, str]], buckets: int = BUCKETS, ridge: float = 1e-5) -> Model:
    """A model of (lang, text) rows on one machine; rows without a letter teach nothing."""
    known = [(k, x) for k, t in sorted(rows) if (x := features(t, buckets)) is not None]
    n = {k: sum(r[0] == k for r in known) for k, _ in known}
    total = {k: sum(x for j, x in known if j == k) for k in n}
    model = solve(Sums(n, total, sum((np.outer(x, x) / n[k] for k, x in known), np.zeros((buckets, buckets)))), ridge)
    right = {k: np.mean([np.sign(x @ model.weights + model.offsets) == model.codes[i] for j, x in known if j == k], axis=0) for i, k in enumerate(model.langs)}
    return trusted(model, right)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from training: crc32 of the doc_id as text, modulo 3, is 1. A null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 300) -> DataFrame:
    """lang, text of the ``per_lang`` rows of least hash of each language (all, if it has fewer), outside the held-out part.

    Two scans: the first ranks the hashes alone, the second reads the texts up to each language's last hash. Both are cut to
    ``per_lang`` rows a language, in each task and then over all, so no number of rows makes the sample smaller or larger.
    """
    usable = docs.where(~held_out(doc_id) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text), F.lit("train")).alias("hash"))
    least = Window.partitionBy("lang").orderBy("hash")

    def cut(of: DataFrame, by: WindowSpec = least) -> DataFrame:
        return of.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_lang)

    # Each task hands on ``per_lang`` rows of a language; they are cut in 256 parts first, so a language of most rows is no single task.
    parts = Window.partitionBy("lang", F.pmod(F.hash("hash"), F.lit(256))).orderBy("hash")
    last = if_few(settle(cut(cut(rows.select("lang", "hash"), parts).select("lang", "hash")).groupBy("lang").agg(F.max("hash").alias("last"))))  # one row per language
    return cut(rows.join(last, "lang").where("hash <= last")).select("lang", "text")


def _with_letters(batches: Iterator) -> Iterator:
    """The rows that teach something."""
    import pyarrow as pa

    with worker_memory("langid"):
        for batch in batches:
            yield batch.filter(pa.array([counts(t.as_py(), 1).any() for t in batch.column(1)], pa.bool_()))


def _solved(known: DataFrame, buckets: int, work: Scratch) -> Model:
    """solve() over the sums of a sample. Tasks of some thousand rows sum up their own; one task, of fixed size, adds these up a part
    at a time and solves, with the one thread that Spark gives a task's linear algebra. The driver gets the model."""
    import pickle

    n = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with worker_memory("langid"):
            total: dict[str, np.ndarray] = {}
            products = np.zeros((buckets, buckets), np.float32)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    some = batch.slice(at, 500)
                    x, w = np.zeros((some.num_rows, buckets), np.float32), np.zeros((some.num_rows, 1), np.float32)
                    for i, (k, t) in enumerate(zip(some.column(0).to_pylist(), some.column(1), strict=True)):
                        x[i], w[i] = features(t.as_py(), buckets), 1 / n[k]
                        total[k] = total.get(k, 0.0) + x[i].astype(float)
                    products += x.T @ (w * x)
            for k, x in total.items():
                yield pa.RecordBatch.from_pydict({"lang": [k], "sum": [x.tobytes()]})
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([products.tobytes()])], names=["lang", "sum"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with worker_memory("langid"):
            out = Sums(n, {k: np.zeros(buckets) for k in n}, np.zeros((buckets, buckets)))
            for batch in batches:
                for lang, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if lang is None:
                        out.products += np.frombuffer(part.as_buffer(), np.float32).reshape(buckets, buckets)
                    else:
                        out.features[lang] += np.frombuffer(part.as_buffer())
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(solve(out))]})

    tasks = max(1, -(-sum(n.values()) // 5000))
    parts = work.settle(known.coalesce(tasks).mapInArrow(run, "lang string, sum binary"))  # a part has 16 MB, so few are made
    return pickle.loads(parts.coalesce(1).mapInArrow(add, "model binary").first().model)


def _right(known: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Each language's shares of rows that each bit's classifier gets right."""
    place = {k: i for i, k in enumerate(model.langs)}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with worker_memory("langid"):
            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    good = np.sign(margins(model, t.as_py())) == model.codes[place[k]]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(good)), pa.array(np.arange(len(good), dtype=np.int32)), pa.array(good.astype(np.int32))], names=["lang", "bit", "right"])

    shares = known.mapInArrow(run, "lang string, bit int, right int").groupBy("lang", "bit").agg(F.avg("right").alias("share"))
    out = {k: np.zeros(model.codes.shape[1]) for k in model.langs}
    for r in shares.collect():  # languages x bits
        out[r.lang][r.bit] = r.share
    return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 300, buckets: int = BUCKETS) -> Model:
    """Train on a sample of ``per_lang`` rows a language (see sample()); rows without a letter teach nothing. No rows: no languages.

    The driver gets languages x bits and buckets x bits numbers, whatever the number of rows.
    """
    work = Scratch(docs.sparkSession)
    known = work.settle(sample(docs, doc_id, text, lang, per_lang).mapInArrow(_with_letters, "lang string, text string"))
    model = _solved(known, buckets, work) if known.limit(1).count() else solve(Sums({}, {}, np.zeros((buckets, buckets))))
    out = trusted(model, _right(known, model)) if model.langs else model
    work.drop()
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous. Null texts and those without a letter: ``und``, score 0.

    Of languages that decode alike the first by name is predicted, as ambiguous. Columns with the new names are replaced; other columns pass
    through, repeated rows each; very long texts are read whole; an empty table gives no rows, a model without languages ``und`` for every row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: buckets x bits
    new = {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}
    kept = [c for c in docs.columns if c not in new]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with worker_memory("langid"):
            model = shared.value
            for batch in batches:
                out = []
                for t in batch.column(kept.index(text)):
                    t = t.as_py()
                    margin = margins(model, t) if t is not None and model.langs else None
                    out.append((UNDETERMINED, 0.0, False) if margin is None else decode(model, margin))
                columns = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + columns, names=kept + list(new))

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{n} {k}" for n, k in new.items()])
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
