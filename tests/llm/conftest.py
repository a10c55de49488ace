import pytest
from pyspark.sql import functions as F

WORDS = "The committee met on Tuesday to weigh three plans for the old harbour and its long neglected quays".split()
LONG = " ".join(f"{WORDS[i % 17]}{i % 613}" for i in range(9_000))
BASE = " ".join(WORDS * 3)

# (doc_id, text): null and empty texts, copies up to case, near copies, ties, repeated rows, null ids, long texts
ROWS = [
    (1, BASE),
    (2, BASE.upper()),
    (3, BASE + " again"),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, "two words"),
    (8, "Two  words"),
    (9, LONG),
    (9, LONG),
    (10, LONG + " with a different ending"),
    (None, "a row without an id but with enough words to have shingles of its own"),
    (None, None),
    (11, "Ünïcode  　 text \x1c\x1d with 😀 emoji, ½ and Ⅷ <|endoftext|> it's 12345 ÀÉ"),
    (12, "x" * 300),
    (13, BASE.replace("Tuesday", "Monday", 1)),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows above with further columns whose names the operators use themselves."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for name in ("size", "node", "digest", "__key", "shard", "score"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
