"""The registered queries against their SQL twins, and the plans they run on."""

from __future__ import annotations

import pytest
from check import difference, duck

import __spark_entry__ as contract
from linkloom.plans import tables
from linkloom.plans.oracle import ORACLE
from linkloom.plans.queries import QUERIES

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def engine():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, engine, name):
    said = difference(spark, engine, name, FOLDER)
    if said == "no rows on either side":  # the smallest tables lack that domain
        said = difference(spark, duck(LARGER), name, LARGER)
    assert said == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["domain", "count"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_binary_archives_use_python(spark):
    for name, query in QUERIES.items():
        text = plan(query(spark, FOLDER))
        uses = any(node in text for node in ("Python", "InPandas", "InArrow", "BatchScan"))
        archives = {"warc_roundtrip", "archive_preview", "archive_manifest", "warc_source", "archive_fetch", "archive_files", "store_overview"}
        assert uses == (name in archives), name


def test_first_wins_limits_groups_before_the_shuffle(spark):
    text = plan(contract.queries()["session_dedup"](spark, FOLDER))
    assert "WindowGroupLimit" in text and "Partial" in text.split("WindowGroupLimit", 1)[1]


def test_scans_read_only_what_they_need(spark):
    text = plan(contract.queries()["page_link_counts"](spark, FOLDER))
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in text
    assert "Exchange" not in text
    text = plan(contract.queries()["dedup_against_seen"](spark, FOLDER))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_returnflag:string>" in text
    assert "PushedFilters: [IsNotNull(l_returnflag), Not(EqualTo(l_returnflag,R))]" in text


def test_links_are_computed_once(spark):
    text = plan(tables.page_links(tables.table(spark, FOLDER, "pages")))
    assert text.count("regexp_extract_all(html") == 1 and "CartesianProduct" not in text
