from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from runsieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    return local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=shared)


@pytest.fixture()
def case_row(spark):
    """Build trace rows from keyword overrides of one matching case."""
    base = {
        "eval_run_id": "r",
        "case_id": "c1",
        "query": "How long may a parcel be returned?",
        "expected_answer": "Thirty days after delivery.",
        "expected_contexts": ["a parcel may be returned within thirty days"],
        "expected_tools": ["search_docs"],
        "answer": "Thirty days after delivery.",
        "retrieved_contexts": ["a parcel may be returned within thirty days"],
        "tool_names": ["search_docs"],
    }
    schema = (
        "eval_run_id string, case_id string, query string, expected_answer string, expected_contexts array<string>, "
        "expected_tools array<string>, answer string, retrieved_contexts array<string>, tool_names array<string>"
    )

    def build(*overrides: dict):
        rows = [{**base, "case_id": f"c{i}", **o} for i, o in enumerate(overrides or ({},))]
        names = [part.split()[0] for part in schema.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    return build
