"""The registered audit queries against their SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from dqaudit.plans import queries, record_queries  # noqa: F401

TABLES = "customer part documents events conversations labels pages orders".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = Counter(tuple(plain(r[cols.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == want and want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_recall_of_texts_that_would_be_markdown(spark, tmp_path):
    # dollars around all words, a link, marks within a word: the documents are plain text
    texts = ["A$$$ one two$$ x$", "see [a link](http://target.org) here", "in**ner** `co`de", "$$ all of it $$", "| --- |", "..."] * 12
    spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("text_recall", "numeric_provenance"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        want = Counter(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall())
        assert Counter(map(tuple, df.collect())) == want and want
