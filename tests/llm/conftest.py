import pytest

from lodestone.llm import common  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, h long"


def _texts():
    prose = "The quick river was running over stones and the old bridge stood near a mill with seven wheels turning slowly in summer light while children played"
    near = prose.replace("seven", "eight")
    rows = [
        (1, prose), (2, prose), (3, near), (4, None), (5, ""), (6, "the of and"), (7, "word"), (8, prose + "\n" + near), (9, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" rest'),
        (10, "é ñ\t中 \x0b x\r\ny  z"), (11, " ".join(f"w{i % 900}x{i}" for i in range(4000))), (12, " \n\t "), (13, "a b c d e f\na b c d e g\na b c d e f h"), (None, "null id text here"), (14, prose.upper()),
        (2, prose),
    ]
    return [(i, t, "en", None if i == 7 else f"s{(i or 0) % 3}", 0, 7, "k", 9) for i, t in rows]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and extra columns with names that operators use inside."""
    return spark.createDataFrame(_texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
