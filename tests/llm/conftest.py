from __future__ import annotations

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture()
def docs(spark):
    """Documents from (id, text) pairs, over several partitions, with an extra column that may clash."""

    def build(rows, parts: int = 3):
        return spark.createDataFrame([(i, t) for i, t in rows], DOCS).repartition(parts)

    return build
