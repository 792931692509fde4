import random
import re

import corpus_pipeline
from lakelore.llm import line_dedup, passage_dedup
from tests.llm.test_dedup import frame

PIECE = re.compile("[^\x20\x09-\x0d]+[\x20\x09-\x0d]*")


def brute_passages(texts, least):
    first, out = {}, []
    for d, t in enumerate(texts):
        pieces = PIECE.findall(t or "")
        words, gone = [x.strip(" \t\n\x0b\f\r") for x in pieces], set()
        for a in range(len(words) - least + 1):
            where = first.setdefault(tuple(words[a : a + least]), (d, a))
            if where[0] != d or a - where[1] >= least:
                gone |= set(range(a, a + least))
        left = [x if i not in gone else x[len(words[i]) :] if "\n" in x and i + 1 not in gone else "" for i, x in enumerate(pieces)]
        out.append(t if not gone else t[: len(t) - len("".join(pieces))] + "".join(left))
    return out


def test_passages(spark, odd, none):
    rng = random.Random(13)
    texts = [None, "", " a b"] + ["".join(rng.choice("abc") + rng.choice([" ", " ", "\n", " \n\t"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    base = [f"w{i}" for i in range(90)]
    for _ in range(30):
        some = list(base[rng.randrange(40) : rng.randrange(50, 90)])
        for _ in range(3):
            some[rng.randrange(len(some))] = rng.choice("xyz")
        texts.append("\n " + " ".join(some))
    texts.append("a " * 300)
    for least in (6, 7, 11):
        got = {r.doc_id: r.text for r in passage_dedup.dedup_passages(frame(spark, texts), min_words=least).collect()}
        assert [got[i] for i in range(len(texts))] == brute_passages(texts, least)
    assert passage_dedup.dedup_passages(odd).count() == 11 and passage_dedup.dedup_passages(none).count() == 0


def test_passages_of_the_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    want = brute_passages([t for _, t in rows], 50)
    got = {r.doc_id: r.text for r in passage_dedup.dedup_passages(docs).collect()}
    assert [got[i] for i, _ in rows] == want != [t for _, t in rows]


def test_passage_planted_within_lines(spark, data):
    """Begins and ends inside longer lines: no whole line repeats."""
    passage = " ".join(f"p{i}" for i in range(51))
    rows = [(i, f"own{i} begin{i} {passage} end{i} own{i}\nlast{i}", "en", "s", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert line_dedup.dedup_lines(docs).where("removed_lines > 0").count() == 0
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, data).collect()}
    assert got == {0: rows[0][1], 1: "own1 begin1 end1 own1\nlast1", 2: "own2 begin2 end2 own2\nlast2"}
