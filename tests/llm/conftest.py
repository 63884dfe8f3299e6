import random

import pytest
from pyspark.sql import functions as F

CLASHES = ("score", "fp", "pii", "text_hash", "size", "h", "skey", "taken", "target", "shard", "version", "digest", "n_tokens", "bucket", "component_id", "row", "positions")


def prose(seed: int, n: int) -> str:
    g = random.Random(seed)
    return " ".join(g.choice(("alpha", "beta", "gamma", "delta", "omega", "Sigma", "kappa,", "tau.", "rho", "été", "naïve", "and", "of", "the")) + str(g.randrange(40)) * (g.random() < 0.4) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """doc_id, text, lang, source, n_chars: nulls in every column, empty and long texts, ties and repeated rows."""
    a = prose(1, 120)
    rows = [
        (1, a, "en", "s1", 1),
        (2, a, "en", "s1", 1),
        (2, a, "en", "s1", 1),
        (2, prose(2, 90), "de", "s2", None),
        (3, "", "en", "s2", 0),
        (4, None, "fr", "s2", None),
        (5, " \t\n ", None, None, 3),
        (None, prose(3, 80), "es", None, 5),
        (None, prose(3, 80), "es", None, 5),
        (None, None, None, None, None),
        (6, prose(4, 30_000), "en", "s3", 9),
        (7, "one", "xx", "s3", 3),
        (8, "one two", "en", "s3", 7),
        (9, a.replace("alpha", "ALPHA"), "en", "s4", 1),
        (10, "For " * 200, "en", "s4", 800),
    ]
    return rows + [(k, prose(k, 60 + k % 50), ("en", "de", "fr", "es")[k % 4], f"s{k % 5}", k) for k in range(100, 140)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    df = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture
def folder(spark, tmp_path):
    """Tables of a query's folder, written for it."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
