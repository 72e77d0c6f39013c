import pytest

SENTENCE = "The quick brown fox jumps over the lazy dog and then runs away from the big bad wolf in the dark forest at night. "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, fp string, ids string, n long"
ODD = [
    (None, "null id x y z", None, None, None, "a", "b", "c", 1),
    (90001, None, None, None, None, None, None, None, None),
    (90002, "", "en", "s", 0, "a", "b", "c", 1),
    (90003, " \n\t ", "en", "s", 4, "a", "b", "c", 1),
    (90004, "two words", "en", "s", 9, "a", "b", "c", 1),
    (90005, SENTENCE * 5, "en", "s", 9, "a", "b", "c", 1),
    (90005, SENTENCE * 5, "en", "s", 9, "a", "b", "c", 1),
    (90006, "zz" + SENTENCE + "yy", "en", "s", 9, "a", "b", "c", 1),
    (90007, "é" * 400 + " " + "日本語、" * 60, "ja", "s", 9, "a", "b", "c", 1),
    (90008, "a b c d e f g " * 4000, "en", "s", 9, "a", "b", "c", 1),
    (90009, "x" * 60000, "en", "s", 9, "a", "b", "c", 1),
]


@pytest.fixture(scope="session")
def docs(spark, sf):
    """Real documents and odd ones, with columns whose names the operators use themselves."""
    real = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").selectExpr("*", "'a' as _text", "'b' as fp", "'c' as ids", "1L as n")
    return real.select(*[f.split()[0] for f in SCHEMA.split(", ")]).unionByName(spark.createDataFrame(ODD, SCHEMA)).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
