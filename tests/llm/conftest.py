import random

import pytest

from strayline.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, score string, fp string, kept string"


def edge_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, and columns named as those operators add."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = [None, "", "   ", "\n\t\x0b", "one", "One", "a b c", "a  b\tc", " a b c", "a b c ", "x" * 50_000, long, "é ñ 漢 \x1c y", "<|endoftext|> it's 12 ok\n\nok", "a b c", None]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", None, "k", None, "f", None) for i, t in enumerate(texts)]
    rows.append(rows[4])
    rows.append(rows[6])
    rows.append((None, "a b c", None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    return stored(spark.createDataFrame(edge_rows(), SCHEMA), "edges")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sentences(n, words, seed=0):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randint(3, 40))) for _ in range(n)]
