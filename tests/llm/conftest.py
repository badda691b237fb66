import pytest

from tests.check import duck


@pytest.fixture(scope="session")
def con(sf):
    return duck(sf)


@pytest.fixture
def documents(spark):
    """Documents with every awkward case: nulls, empty and long texts, repeated rows and
    ids, and columns named like those the operators make."""
    words = [f"w{i % 997}x{i * 7919 % 1013}" for i in range(9000)]
    passage = " ".join(words[:70])
    rows = [
        (1, passage + " first end", "a"), (2, "start " + passage, "b"), (2, "start " + passage, "b"), (3, None, None),
        (None, passage, "n"), (None, None, None), (4, "", "c"), (5, " \t\n ", "d"), (6, " ".join(words), "e"),
        (6, "another text of the same id", "f"), (7, passage + " first end", "g"), (8, "é ñ 世界 <|im_end|> 🙂", None),
    ]
    extra = [(i, t, s, "x", 1, 2, "y", "z", 3.0) for i, t, s in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, id string, key int, fp int, doc string, "
                                        "rules string, score double")


@pytest.fixture
def nothing(documents):
    return documents.limit(0)
