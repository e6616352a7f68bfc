"""Every query with SQL against that SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from postloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        row = []
        for v in r:
            if hasattr(v, "tolist") and hasattr(v, "shape") and v.shape:
                v = v.tolist()  # array columns
            if v is None or v is pd.NA or v is pd.NaT or v != v:
                row.append(None)
            elif isinstance(v, float):
                row.append(int(v) if v == int(v) else round(v, 6))
            else:
                row.append(v)
        out.append(tuple(row))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf, name):
    got, wanted = catalogue.queries()[name](spark, sf).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_every_filter_reason_and_theme_has_rows(spark, sf):
    reasons = {r["reason"] for r in catalogue.queries()["rule_filter_reasons"](spark, sf).collect()}
    assert reasons == {"pass", "empty", "too_short_junk", "promocode", "discount", "subscribe_cta", "ad_label", "sponsored", "urgency_promo", "webinar_spam", "scam", "gambling", "invite_link", "link_spam", "low_text_signal"}
    themes = {r["theme"] for r in catalogue.queries()["theme_distribution"](spark, sf).collect()}
    assert themes == {"work", "technology", "tools", "gaming", "software", "business", "science", "politics", "other"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_reach_the_scan(spark, sf):
    """Only the columns that a query needs are read, and its filter is pushed."""
    from postloom.sources.tables import table

    plan = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "o_comment" not in plan


def test_brief_dates_by_the_first_stored_source(spark, tmp_path):
    """Sources of one number: the row stored first gives the date that a brief counts from, however the rows are dealt."""
    import datetime as dt

    sf = tmp_path / "sf"
    sf.mkdir()
    day = lambda k: dt.datetime(2000, 1, 1) + dt.timedelta(days=k)
    lines = pd.DataFrame([(k, 1, day(n * 7 % 100 + k)) for n in range(6) for k in range(300)], columns=["l_orderkey", "l_linenumber", "l_shipdate"])
    lines.to_parquet(sf / "lineitem.parquet", row_group_size=50, coerce_timestamps="us")
    pd.DataFrame({"o_orderkey": range(300), "o_orderdate": [day(0)] * 300}).to_parquet(sf / "orders.parquet", coerce_timestamps="us")
    pd.DataFrame({"doc_id": range(300), "text": ["news, через 5 дней"] * 300, "source": "s", "lang": "en"}).to_parquet(sf / "documents.parquet")
    con = duckdb.connect(config={"threads": 1})  # in the order of the file
    for t in ("lineitem", "orders", "documents"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = catalogue.queries()["brief_view"](spark, str(sf)).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows(got) == rows(con.sql(catalogue.oracle_sql()["brief_view"]).df())
