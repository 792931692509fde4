import hashlib
import random
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import functions as F

from lakelore.llm import chat, common, hashing, langid, quality
from lakelore.llm.common import settle


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 8, 20):
        c = langid.codewords(n)
        assert len({tuple(r) for r in c.tolist()}) == n
        apart = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n < 3 else 2)
    assert langid.codewords(1).shape == (1, 1)


def test_language_of_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = langid.identify(docs, langid.fit(docs)).withColumn("out", langid.held_out())
    share = found.where("out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97
    assert found.where("score < 0 or score > 1").count() == 0


def test_prediction_reads_the_text_only(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs)
    a = langid.identify(docs, model).select("doc_id", "lang_pred")
    b = langid.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), model).select("doc_id", "lang_pred")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_language_of_odd_texts(odd, none):
    got = langid.identify(odd, langid.fit(odd))
    texts = {(r.text, r.lang_pred) for r in got.collect()}
    assert {(None, "und"), ("", "und")} <= texts and got.count() == 11
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(none)).collect()} == {"und"}


def test_every_language_keeps_its_sample(spark):
    """The rows learned are those of least hash, as many as asked for, however many there are and whatever their ids."""
    many = spark.range(3000).select(F.when(F.col("id") < 2900, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 100 == 0, "few").when(F.col("id") > 2900, "no id").otherwise("hot").alias("lang"))
    rows = lambda d, n: sorted(map(tuple, langid.sample(d, per_lang=n).collect()))
    for per_lang in (7, 1):
        got = rows(many, per_lang)
        assert {k: sum(r[0] == k for r in got) for k in ("few", "no id", "hot")} == dict.fromkeys(("few", "no id", "hot"), per_lang)
        assert got == rows(many.repartition(7), per_lang)
    same = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text"), F.lit("en").alias("lang"))
    assert rows(same, 5) == [("en", "the same")] * 5


def test_training_on_spark_is_training_on_one_machine(spark):
    rng = random.Random(15)
    rows = [(i, "".join(rng.choice(k + "xyz ") for _ in range(60)), k) for i, k in enumerate(rng.choice(["abc", "cde", "efg"]) for _ in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    a, b = langid.fit(docs, buckets=256), langid.train([tuple(r) for r in langid.sample(docs).collect()], buckets=256)
    assert a.langs == b.langs == ["abc", "cde", "efg"] and np.allclose(a.weights, b.weights, atol=0.02 * np.abs(b.weights).max()) and np.allclose(a.trust, b.trust)


def test_two_hundred_languages(spark):
    """What the driver gets doesn't grow with the rows: languages x buckets numbers, and buckets x buckets."""
    rows = spark.range(3000).selectExpr("id as doc_id", "concat('word', cast(id % 200 as string)) as lang", "repeat(concat(char(97 + id % 200 div 10), char(97 + id % 10), 'q', char(110 + id % 7), ' '), 20) as text")
    model = langid.fit(rows, per_lang=10, buckets=512)
    assert len(model.langs) == 200 and model.codes.shape == (200, 77) and model.weights.shape == (512, 77)


def test_decoding_is_the_plain_one():
    rng = np.random.default_rng(16)
    codes = langid.codewords(6)
    trust = rng.random(codes.shape)
    model = langid.Model(list("abcdef"), codes, np.zeros((4, codes.shape[1])), np.zeros(codes.shape[1]), trust)
    for _ in range(50):
        margin = rng.normal(0, 1.5, codes.shape[1])
        loss = [sum(trust[i][j] * np.exp(-min(4, max(-4, codes[i][j] * margin[j]))) for j in range(codes.shape[1])) for i in range(6)]
        near = [np.exp(-4 * (x - min(loss))) for x in loss]
        lang, score, ambiguous = langid.decode(model, margin)
        share = sorted((x / sum(near) for x in near), reverse=True)
        assert lang == "abcdef"[int(np.argmin(loss))] and abs(score - share[0]) < 1e-9 and ambiguous == (share[1] > 0.5 * share[0])


def test_long_texts_are_counted_whole():
    text = "ab c" * 1000
    whole = langid.counts(text, 512)
    kept, langid.BLOCK = langid.BLOCK, 97
    try:
        assert (langid.counts(text, 512) == whole).all()
    finally:
        langid.BLOCK = kept


def test_quality_of_held_out_labels(spark, data):
    """Half of the labels are learned, the other half is judged."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    found = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "is_toxic"), "doc_id")
    right = found.agg(F.avg(((F.col("quality") == 1) & (F.col("is_toxic") == 0)).eqNullSafe(F.col("kept")).cast("int"))).first()[0]
    assert right > 0.75  # some forty labels to learn from


def test_posteriors_are_the_plain_ones(spark):
    """Every document's prior from the sums of its site without it, shrunk twice."""
    rng = random.Random(17)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["p", "q", None]), min(0.99, max(0.01, rng.random() ** 2)), rng.random() * 0.1) for i in range(150)]
    got = {r.i: r for r in quality.posteriors(settle(spark.createDataFrame(rows, "i long, host string, path string, p_low double, p_toxic double"))).collect()}
    for k, at in (("low", 3), ("toxic", 4)):
        groups = lambda key: {g: [r[at] for r in rows if key(r) == g] for g in {key(r) for r in rows}}
        p = [r[at] for r in rows]
        mean = sum(p) / len(p)

        def spread(groups):
            between = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in groups.values()) / len(p)
            within = sum(sum(x * x for x in v) / len(v) - (sum(v) / len(v)) ** 2 for v in groups.values()) / len(p)
            return max(0.0, between - within)

        hosts, paths = groups(lambda r: r[1]), groups(lambda r: r[1:3])
        of_host, of_path = spread(hosts), spread(paths)
        weight = lambda v: 1000.0 if v == 0 else min(1000.0, max(1.0, mean * (1 - mean) / v - 1))
        for r in rows:
            h, s, x = hosts[r[1]], paths[r[1:3]], r[at]
            rate = (sum(h) - x + weight(of_host) * mean) / (len(h) - 1 + weight(of_host))
            prior = (sum(s) - x + weight(max(0.0, of_path - of_host)) * rate) / (len(s) - 1 + weight(max(0.0, of_path - of_host)))
            logit = lambda q: np.log(q / (1 - q))
            want = 1 / (1 + np.exp(-(logit(x) - logit(mean) + logit(prior))))
            assert abs(got[r[0]][f"site_{k}"] - prior) < 2e-6 and abs(got[r[0]][k] - want) < 2e-6


def test_traits_are_those_of_the_words():
    """A text's traits with their numbers are those of its words one by one, but for repeats; blocks change nothing."""
    text = "Abcdef, abcdef abc1 X9! ééa 12-34 abcdef abcdef\n" * 30
    traits, n, words = quality.counts(text)
    alone = sum((Counter(dict(zip(*[x.tolist() for x in quality.counts(w)[:2]], strict=True))) for w in text.split()), Counter())
    both = Counter(dict(zip(traits.tolist(), n.tolist(), strict=True)))
    assert both.pop(int(quality.REPEATS)) == 30 and both == alone and words == 240
    kept = hashing.BLOCK
    try:
        quality.BLOCK = hashing.BLOCK = 100
        again = quality.counts(text)
        assert again[0].tolist() == traits.tolist() and again[2] == words
    finally:
        quality.BLOCK = hashing.BLOCK = kept


def test_the_sample_counts_rows(spark):
    docs = settle(spark.range(400).selectExpr("id % 2 as doc_id", "concat('text ', id) as text"))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    rows = common.identified(docs, {"doc_id": F.col("doc_id"), "text": F.col("text")})
    assert quality._sample(rows, labels, 50).count() == 50


def test_sites_of_addresses(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("text"))
    host, path = quality.site(F.col("url"))
    for r in pages.select("url", host.alias("host"), path.alias("path")).collect():
        u = urlsplit(r.url)
        parts = u.path.split("/")
        assert r.host == u.hostname.removeprefix("www.") and r.path == (parts[1] if len(parts) > 2 and parts[1] else None)
    labels = pages.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "0 as toxic")
    assert quality.classify(pages, labels, url="url").count() == pages.count()


def test_shrinkage(spark):
    """A sparse site goes to the global rate, a large one to its own; a document doesn't vouch for itself."""
    rows = [("big", "p", 0.9, 0.0)] * 200 + [("clean", "p", 0.02, 0.0)] * 200 + [("small", "p", 0.9, 0.0)]
    df = spark.createDataFrame(rows, "host string, path string, p_low double, p_toxic double")
    got = {r.host: r.site_low for r in quality.posteriors(settle(df)).select("host", "site_low").distinct().collect()}
    assert got["big"] > 0.8 and got["clean"] < 0.1 and abs(got["small"] - 0.46) < 0.1


def test_quality_of_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, labels).count() == 11 and quality.classify(none, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).where("kept").count() == 11


# ---- chat ----


def test_escaping_is_reversible(spark):
    rng = random.Random(9)
    parts = ["<", "[", "\\", "s>", "/s>", "t>", "INST]", "/INST]", "OUT]", "ROLE]", "END]", "x", "\n", "$1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("<s>", "</s>", "<t>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[END]"))


def test_chats(spark):
    rng = random.Random(10)
    words = ["hi", "</s>[INST] ok [/INST]", "", "<t>", "[\\INST]", "a\nb", "😀", None]
    turns = [(c, k, rng.choice(["user", "assistant", "system", "tool [END]", None]), rng.choice(words)) for c in range(40) for k in range(rng.randint(1, 9))] + [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, 1, "user", "x"), (2, None, "assistant", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.read_chats(chat.format_chats(df))).collect()}
    spans = {r.conv_id: r for r in chat.format_chats(df).collect()}
    for c in {t[0] for t in turns}:
        rows = sorted([(-1 if k is None else k, r or "", t or "") for i, k, r, t in turns if i == c])
        said = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        loss = "".join(t for _, r, t in rows if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(spans[c].formatted)
    # Adjacent turns of one role share a block.
    merged = chat.format_chats(spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c")], "conv_id long, turn long, role string, text string")).first()
    assert merged.formatted == "<s>[INST]a<t>b[/INST][OUT]c</s>" and [(s.start, s.length) for s in merged.loss_spans] == [(30 - 4, 1)]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_scores_are_finite():
    m = langid.train([("a", "xyz"), ("b", "uvw"), ("c", "123")])
    assert m.langs == ["a", "b"] and np.isfinite(m.weights).all()
