import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _k string, h string, size string"


def rows():
    long = " ".join(f"w{i % 977} tail{i}" for i in range(30_000))
    base = [
        (1, "The cat sat on the mat and looked at the moon all night long.\nSecond line here today.", "en", "a"),
        (2, "The cat sat on the mat and looked at the moon all night long.\nSecond line here today.", "en", "b"),
        (2, "The cat sat on the mat and looked at the moon all night long.\nSecond line here today.", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, "a"),
        (5, "   \n\t ", "fr", None),
        (None, "Le chat noir est sur la table et il regarde la lune toute la nuit.", "fr", None),
        (None, None, None, None),
        (6, "Le chat noir est sur la table et il regarde la lune toute la nuit.", "fr", "c"),
        (7, "12345 !!! ... ###", "en", "c"),
        (8, "ﬁne É é 　x\u0000y <|endoftext|> </s> 😀 漢字", "en", "c"),
        (9, long, "en", "a"),
        (10, "x" * 60_000, "en", "a"),
        (11, "one two", "en", "a"),
        (7, "another row of the same id with another text", "en", "c"),
        (-(1 << 62), "a very small id with some words in the text", "en", "a"),
    ]
    return [(i, t, l, s, None if t is None else len(t), 0.5, "k", "h", "s") for i, t, l, s in base]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and columns of clashing names."""
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (6, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
