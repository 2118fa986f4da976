"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from versara import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(df):
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(str([plain(None if str(v) in ("<NA>", "nan", "None", "NaT") else v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(queries.ORACLE_SQL[name]).df())


def test_psalms_verse_by_verse(duck):
    """The counts of the whole sweep, from SQL that walks the parts and knows nothing of the intervals."""
    got = duck.execute(queries.ORACLE_SQL["greek_numbering_sweep"]).df().iloc[0]
    assert (got.refused, got.verses, got.titles, got.targets) == (14, 2444, 68, 2506)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc", "n_words", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_only(spark, sf):
    got = {r.ref: (r.reference, r.error_kind) for r in queries.QUERIES["parse_references"](spark, sf).collect()}
    assert got["Jn 3:16-17,20"] == ("John 3:16-17,20", None) and got["John 3:99"] == (None, "out_of_range")
