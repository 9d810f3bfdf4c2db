"""Scorers that come from outside: a Python function over batches of requests."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[pd.DataFrame], pd.Series]

_REGISTRY: dict[str, Scorer] = {}
_OUT = "eval_run_id string, case_id string, metric string, backend string, score double, error string, traceback string"


def register_scorer(name: str, scorer: Scorer) -> None:
    """Register a function from a batch of request rows to one score per row."""
    _REGISTRY[name] = scorer


def registered_scorers() -> list[str]:
    return sorted(_REGISTRY)


def apply_scorer(requests: DataFrame, name: str, metric: str) -> DataFrame:
    """Run a scorer over Arrow batches; an unknown name gives no rows.

    A batch that fails, or gives another number of scores than it has rows, is halved until the failing
    rows stand alone; they end up with an error text and a traceback. One bad row among n costs about
    2 log2(n) further calls.
    """
    spark = requests.sparkSession
    if name not in _REGISTRY:
        return spark.createDataFrame([], _OUT)
    scorer = _REGISTRY[name]

    def scored_rows(pdf: pd.DataFrame) -> list[tuple]:
        try:
            values = list(scorer(pdf))
            if len(values) != len(pdf):
                raise ValueError(f"{len(values)} scores for {len(pdf)} rows")
            return [(None if pd.isna(v) else float(v), None, None) for v in values]
        except Exception as exc:  # noqa: BLE001 - any scorer fault becomes an error row
            if len(pdf) == 1:
                return [(None, f"{type(exc).__name__}: {exc}", traceback.format_exc())]
        half = len(pdf) // 2
        return scored_rows(pdf.iloc[:half]) + scored_rows(pdf.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = scored_rows(pdf) if len(pdf) else []
            scored = pd.DataFrame(rows, columns=["score", "error", "traceback"], index=pdf.index)
            yield pd.concat([pdf[["eval_run_id", "case_id"]], scored], axis=1).assign(metric=metric, backend=name)[
                ["eval_run_id", "case_id", "metric", "backend", "score", "error", "traceback"]
            ]

    return requests.mapInPandas(run, _OUT)
