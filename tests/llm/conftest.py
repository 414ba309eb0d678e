import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF001


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) rows, with columns that clash with internal names."""

    def make(rows):
        return spark.createDataFrame(
            [(k, t, None, "s", None if t is None else len(t), "x", 1) for k, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, `key` string, shard int")

    return make


LONG = " ".join(f"word{i % 977} part{i}" for i in range(30_000))


@pytest.fixture
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    return [(1, "One line here.\nAnother line there."), (1, "One line here.\nAnother line there."), (2, None), (3, ""),
            (4, " \n\t "), (None, "One line here.\nAnother line there."), (None, None), (5, LONG), (6, LONG),
            (7, "\U0001f600 été 中文"), (8, "a"), (9, "!!! ??? 123")]
