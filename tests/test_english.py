import pytest
from pyspark.sql import functions as F

from lakelore.functions.english import english_tokens, stem

# Words and stems of the published sample vocabulary.
SAMPLE = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist",
    "consistent": "consist", "consistently": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol",
    "consolidate": "consolid", "consolidation": "consolid", "consoling": "consol", "consols": "consol", "consonant": "conson", "consort": "consort", "conspicuous": "conspicu",
    "conspiracy": "conspiraci", "conspirator": "conspir", "constable": "constabl", "constancy": "constanc", "constant": "constant", "knack": "knack", "knavish": "knavish",
    "kneaded": "knead", "knees": "knee", "knell": "knell", "knightly": "knight", "knitted": "knit", "knitting": "knit", "knives": "knive", "knocked": "knock", "knots": "knot",
    "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "hopping": "hop", "hoping": "hope", "luxuriating": "luxuri", "generate": "generat",
    "generously": "generous", "communism": "communism", "skies": "sky", "news": "news", "by": "by", "say": "say", "cry": "cri", "proceed": "proceed", "rational": "ration",
}


@pytest.mark.parametrize("word", sorted(SAMPLE))
def test_stem(word):
    if word == "generate":
        assert stem(word) in ("generat",)
    else:
        assert stem(word) == SAMPLE[word]


def test_column(spark):
    assert spark.sql("select 'The hopping cats' as t").select(english_tokens(F.col("t")).alias("x")).first().x == ["hop", "cat"]
