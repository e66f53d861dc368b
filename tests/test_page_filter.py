"""The page filter's queries against their SQL on texts where Java's patterns and SQL's part ways."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

NUMBERS = " 12 34 56 78 "
LONG = " word" * 60
TEXTS = [
    "avecrére" + NUMBERS + LONG,  # the unit ends before an accented letter
    "écr" + NUMBERS + LONG,
    "cr" + NUMBERS + LONG,
    "é2004é" + NUMBERS + LONG,
    "٣٤ ٥٦" + NUMBERS.replace("78", "٧٨") + LONG,  # digits that are not ASCII
    "laKh" + NUMBERS + LONG,
    "bpſ" + NUMBERS + LONG,
    "per\x0bcent" + NUMBERS + LONG,
    "half year" + NUMBERS + LONG,
    "\n" * 300,
    " " * 300,
    " " * 300,
    "\x0b  ",
    "Contents " + NUMBERS + LONG,
    "a\nContents \nb" + NUMBERS + LONG,
    " ".join(["2004"] * 4 + ["x"] * 100),
    " ".join(["2001"] * 4 + ["x"] * 380),  # 312.5 thousandths
    "0.5.6,7,,8é 9_ 1,2" + LONG,
    "",
    None,
]


@pytest.mark.parametrize("name", ["page_prefilter", "page_scores"])
def test_filter_equals_its_sql(spark, tmp_path, name):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = entry.oracle_sql()[name]
    got = entry.queries()[name](spark, os.fspath(tmp_path))
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_scores_are_summed_before_they_are_rounded(spark, tmp_path):
    spark.createDataFrame([(1, TEXTS[16])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = entry.queries()["page_scores"](spark, os.fspath(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(entry.oracle_sql()["page_scores"]).fetchall())
    assert 313 in {r["thousandths"] for r in got}
