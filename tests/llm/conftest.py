import re

import duckdb
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"

LONG = "The long text goes on and on, word after word.\n" * 20_000
COPY = " ".join(f"word{i}" for i in range(60))
# Ids, texts and sources of every awkward kind: nulls, blanks, repeats, no words, one long word.
NASTY = [
    (1, None, "a"),
    (2, "", None),
    (3, " \t\n\x0b\x0c\r ", "b"),
    (4, COPY, "a"),
    (5, COPY, "a"),
    (5, COPY, "a"),
    (None, COPY + " end", "c"),
    (None, None, None),
    (6, "x" * 50_000, "b"),
    (7, LONG, "b"),
    (8, "é ß \U0001f600 　 non breaking", "c"),
    (9, "one", "c"),
    (-(2**63), "two words", "c"),
    (2**63 - 1, "<|endoftext|> in a text", "d"),
    (10, "\n\n", "d"),
    (10, "another text of the same id", "d"),
]
# Names that operators use inside must not matter in their input.
CLASHING = "key long, row string, words string, __text string, chunk int, id string, kept boolean"


@pytest.fixture(scope="session")
def make_docs(spark):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"

    def build(rows):
        full = [
            (i, text, "en", source, len(text) if text else None, 1, "r", None, "t", 2, "i", True)
            for i, text, source in rows
        ]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def nasty(make_docs):
    return make_docs(NASTY).repartition(3)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def rows():
    """``(doc_id, text, source)`` of the small table, by id."""
    return duckdb.sql(
        f"SELECT doc_id, text, source FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id"
    ).fetchall()
