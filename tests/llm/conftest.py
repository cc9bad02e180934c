import datetime

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.01"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = "the of and a to in is was for that on with as by at from it an be this which or are not have had".split()


def prose(seed: int, n: int) -> str:
    import random

    rnd = random.Random(seed)
    out = []
    for k in range(n):
        out.append(rnd.choice(WORDS) if rnd.random() < 0.5 else "".join(rnd.choice(("ka", "lo", "mi", "ter", "an", "so")) for _ in range(rnd.randint(2, 4))))
        if k % 9 == 8:
            out[-1] += "."
    return " ".join(out)


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd characters."""
    rows = [(k, prose(k, 40 + 7 * k), "en", f"s{k % 3}", None) for k in range(24)]
    rows += [(30, rows[0][1], "en", "s0", 5), (31, rows[0][1], "en", None, 5)]  # copies
    rows += [(32, None, None, None, None), (None, None, None, None, None), (33, "", "", "", 0), (None, rows[1][1], "en", "s1", 1)]
    rows += [(34, " \t\n", "en", "s1", 3), (35, "one", "en", "s1", 3), (36, "one two three", "en", "s1", 3), (37, "one two three", "en", "s1", 3)]
    rows += [(40, rows[2][1], "en", "s2", 1), (40, rows[2][1], "en", "s2", 1), (40, rows[3][1], "en", "s2", 1)]  # repeated rows and ids
    rows += [(50, prose(50, 9000), "en", "s0", 1), (51, "x" * 3000 + " é漢字🎉 ’tis don't <|endoftext|>   z  \n\n end", "xx", "s0", 1), (52, "A\x00b\x0bC\x0cd\x1ce", "xx", "s0", 1)]
    words = rows[5][1].split()
    rows += [(60 + k, " ".join(words[:k] + ["zz"] + words[k + 1 :]), "en", "s1", 1) for k in (0, 1, 40)]  # near copies
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns named like what operators add."""
    from pyspark.sql import functions as F

    extra = {c: F.lit(c) for c in ("ids", "n_tokens", "decoded", "shard", "slot", "quality", "toxicity", "size", "key", "node", "taken", "score", "row", "tie", "range")}
    return odd.withColumns(extra).withColumn("day", F.lit(datetime.date(2020, 1, 1)))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
