"""Operators against their SQL on small tables with nulls, empty texts, copies and odd characters."""

import duckdb
import pandas as pd
import pytest

from erario.llm import decontaminate, quality_rules
from erario.llm.oracle import ORACLE

LONG = " ".join(f"Word{i % 90}, and" for i in range(150))
TEXTS = [
    LONG, LONG + ".", None, "", " \n\t", "one two", "Äöü ñandú 日本語 " * 40, "a b c d e f g h " * 30, "same line here\n" * 30, "ABC DEF " * 20 + "$$$$ ####",
    "x " * 300, "tab\tand\x0bvertical\x0cfeed\r\nline. End", " ".join(f"w{i}" for i in range(250)) + "!", "." * 40, "word " * 2500 + "other",
]
ITEMS = [(1, LONG[100:400]), (2, "TWO"), (3, None), (4, ""), (10, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15")]


def by_sql(name, **tables):
    con = duckdb.connect()
    for table, (rows, columns) in tables.items():
        con.register(table + "_df", pd.DataFrame(rows, columns=columns))
        con.execute(f"CREATE TABLE {table} AS SELECT CAST({columns[0]} AS BIGINT) AS {columns[0]}, CAST(text AS VARCHAR) AS text FROM {table}_df")
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    return sorted((dict(zip(names, r)) for r in rel.fetchall()), key=lambda r: r["doc_id"])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)


def test_quality_rules(docs):
    got = sorted((r.asDict() for r in quality_rules.digest(quality_rules.judge(docs)).collect()), key=lambda r: r["doc_id"])
    assert got == by_sql("op1_quality_rules", documents=(list(enumerate(TEXTS)), ["doc_id", "text"]))


def test_decontamination(spark, docs):
    hits = decontaminate.hits(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = sorted((r.asDict() for r in decontaminate.digest(hits).drop("spans").collect()), key=lambda r: r["doc_id"])
    assert got == by_sql("op3_decontamination", documents=(list(enumerate(TEXTS)), ["doc_id", "text"]), benchmark=(ITEMS, ["item_id", "text"]))


def test_cascade_takes_what_the_rules_before_leave():
    # b rejects most, but nothing that a leaves; c is dear
    patterns = [([True, True, False], 50, [50, 50, 5000]), ([False, False, True], 20, [20, 20, 2000]), ([False, False, False], 30, [30, 30, 3000])]
    assert quality_rules.greedy(patterns, ["a", "b", "c"]) == ["a", "b", "c"]
    patterns[0] = ([True, True, False], 50, [500, 50, 50])
    patterns[1] = ([False, False, True], 20, [20, 20, 20])
    patterns[2] = ([False, False, False], 30, [30, 30, 30])
    assert quality_rules.greedy(patterns, ["a", "b", "c"]) == ["b", "c", "a"]
    assert quality_rules.greedy([], ["a", "b"]) == ["a", "b"]
