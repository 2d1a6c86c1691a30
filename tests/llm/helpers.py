"""Small tables for the operator tests."""

import os

import pyarrow.parquet as pq

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def rows_of(sf_dir, name):
    """The table as a list of dicts."""
    return pq.read_table(os.path.join(sf_dir, f"{name}.parquet")).to_pylist()


#: Nulls in every column, an empty text, a repeated row, white space only, and other columns with names that operators use.
ODD = [
    (1, "one two three four five six\nseven eight", "x", 1),
    (2, None, "x", 2),
    (3, "", None, 3),
    (None, "no id here", "y", 4),
    (1, "one two three four five six\nseven eight", "x", 1),
    (4, " \t\n\x0b ", "y", None),
    (5, "é日本\U0001f389  a b\r\n c", "y", 6),
    (6, "long " * 30000, "z", 7),
]
ODD_SCHEMA = "doc_id long, text string, source string, `n_tokens` int"


def odd_docs(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
