"""The contract of model calls: a function of a batch, run in Arrow batches on the executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score(df: DataFrame, make: Callable[[], Scorer], schema: T.StructType | str, batch_rows: int | None = None, attempts: int = 1, wait: float = 0.5) -> DataFrame:
    """Rows of scorer(batch) for every batch of df.

    make() is called once a task, so weights are loaded where they are used; a failing batch is tried again after
    a doubling wait, then fails the task, which Spark tries elsewhere (D10). batch_rows bounds what a call gets.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for b in batches:
            step = batch_rows or max(1, len(b))
            for i in range(0, len(b), step):
                part, pause = b.iloc[i : i + step].reset_index(drop=True), wait
                for left in range(attempts - 1, -1, -1):
                    try:
                        yield scorer(part)
                        break
                    except Exception:
                        if not left:
                            raise
                        time.sleep(pause)
                        pause *= 2

    return df.mapInPandas(run, schema)


def lemmas(df: DataFrame, column: str, make: Callable[[], Callable[[str], str]], name: str = "lemmas") -> DataFrame:
    """df with the column's words replaced by what an injected lemmatiser says of each (F26); make() is called once a task."""

    def scorer() -> Scorer:
        say = make()
        return lambda b: b.assign(**{name: [None if t is None else " ".join(map(say, t.split())) for t in b[column]]})

    return score(df, scorer, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))
