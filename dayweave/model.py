"""Applying a user-supplied model to a request table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def apply_model(
    requests: DataFrame, answer: Callable[[list[str]], Sequence[str]], *, text: str = "content", batch_size: int = 8, parallel: int | None = None
) -> DataFrame:
    """Add ``answer`` and ``error`` to every request.

    The callable gets up to ``batch_size`` texts at a time. When a batch fails its texts are tried one
    by one, and a text that still fails keeps its error, so one bad request never stops the rest.
    ``parallel`` bounds the number of tasks and with it the calls in flight.
    """
    rows = requests.repartition(parallel) if parallel else requests
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def one(body: str) -> tuple[str | None, str | None]:
        try:
            return answer([body])[0], None
        except Exception as failure:
            return None, f"{type(failure).__name__}: {failure}"

    def many(bodies: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            found = list(answer(bodies))
            if len(found) == len(bodies):
                return [(x, None) for x in found]
        except Exception:
            pass
        return [one(b) for b in bodies]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = pdf[text].tolist()
            results = [r for i in range(0, len(bodies), batch_size) for r in many(bodies[i : i + batch_size])]
            yield pdf.assign(answer=[r[0] for r in results], error=[r[1] for r in results])

    return rows.mapInPandas(work, schema)


def require_some_success(answers: DataFrame) -> DataFrame:
    """Fail only when there were requests and all of them failed."""
    totals = answers.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
    if totals["n"] and totals["n"] == totals["bad"]:
        raise RuntimeError(f"all {totals['n']} requests failed")
    return answers


def describe_by_rules(bodies: list[str]) -> list[str]:
    """Deterministic stand-in for a model: the first non-empty line, in the one-frame answer form."""
    first = [next((line.strip() for line in b.splitlines() if line.strip()), "nothing") for b in bodies]
    return [f"description: {line} | activity: {line.split()[0].lower()} | apps: [] | topics: rules" for line in first]
