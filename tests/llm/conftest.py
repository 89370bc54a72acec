from __future__ import annotations

import pytest

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score DOUBLE, id STRING, piece INT"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text[, lang]) rows, with extra columns whose names operators use themselves."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, 0.5, "x", 7) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def table(spark):
    return lambda name, sf="0.001": spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")
