import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Columns whose names operators use for results or helpers.
CLASH = ["_text", "_id", "n", "key", "node", "score", "kept", "length", "_len", "n_tokens", "root", "train"]


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (id, text) pairs, with columns of clashing names on request."""

    def build(rows, clash: bool = False):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASH])
        return df

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty, blank, very long, repeated and unusual texts, with clashing columns."""
    rng = random.Random(5)
    long_text = " ".join(words(rng, 30_000))
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "plain text of six short words"), (4, "plain text of six short words"),
        (None, "an id is missing here now"), (None, None), (5, long_text), (6, "<s> <|endoftext|> </s> Übung ñandú 日本語"),
        (7, "plain text of six short words"), (8, "\0 zero  byte"), (9, "..., !!! ???"), (4, "another text with id four"),
    ]
    return make(rows, clash=True)


@pytest.fixture(scope="session")
def nothing(make):
    return make([], clash=True)
