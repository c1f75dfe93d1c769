"""Predictors: anything that answers prompts; answers are counted per pair and template."""

from __future__ import annotations

import time
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


class Predictor(Protocol):
    """Answers a batch of prompts at a temperature; called in Arrow batches on the executors."""

    def answer(self, prompts: pd.Series, temperature: float) -> pd.Series: ...


class KeywordPredictor:
    """Says yes where a prompt holds a keyword, no otherwise: a stand-in for tests."""

    def __init__(self, keyword: str):
        self.keyword = keyword

    def answer(self, prompts: pd.Series, temperature: float) -> pd.Series:
        return prompts.str.contains(self.keyword, regex=False).map({True: "Yes", False: "No"})


class FailingPredictor:
    """Fails a few times before it answers like ``KeywordPredictor``: a stand-in for a service in tests."""

    def __init__(self, keyword: str, failures: int):
        self.inner, self.failures = KeywordPredictor(keyword), failures

    def answer(self, prompts: pd.Series, temperature: float) -> pd.Series:
        if self.failures:
            self.failures -= 1
            raise ConnectionError("no answer")
        return self.inner.answer(prompts, temperature)


class RetryingPredictor:
    """Asks another predictor again after an error, each time after twice the wait.

    Without an answer after ``attempts`` the prompts of the batch get none (null),
    which counts as not valid, rather than failing the task and all its answers.
    """

    def __init__(self, inner: Predictor, attempts: int = 5, wait: float = 1.0):
        self.inner, self.attempts, self.wait = inner, attempts, wait

    def answer(self, prompts: pd.Series, temperature: float) -> pd.Series:
        for k in range(self.attempts):
            try:
                return self.inner.answer(prompts, temperature)
            except Exception:  # whatever a service's client raises
                if k + 1 < self.attempts:
                    time.sleep(self.wait * 2**k)
        return pd.Series([None] * len(prompts), index=prompts.index, dtype=object)


_MODELS: dict[str, type] = {"keyword": KeywordPredictor, "failing": FailingPredictor, "retrying": RetryingPredictor}


def register(name: str, maker) -> None:
    _MODELS[name] = maker


def create(name: str, *args) -> Predictor:
    """A predictor by name."""
    if name not in _MODELS:
        raise KeyError(f"unknown predictor {name!r}; known: {sorted(_MODELS)}")
    return _MODELS[name](*args)


def ground_truth(label: str = "label") -> Column:
    """Answers that are always right."""
    return F.when(F.col(label) == 1, "Yes").otherwise("No")


def threshold_answer(score: str, threshold: float) -> Column:
    return F.when(F.col(score) >= threshold, "Yes").otherwise("No")


def predict(prompts: DataFrame, predictor: Predictor, repeat: int = 1, temperatures: tuple[float, ...] = (0.0,)) -> DataFrame:
    """``answer`` of every prompt, temperature and repetition; ``n`` numbers the repetitions."""
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.lit(i).alias("n")) for t in temperatures for i in range(repeat)]))
    asked = prompts.withColumn("_g", grid).select("*", "_g.temperature", "_g.n").drop("_g")

    def run(batches):
        for pdf in batches:
            parts = [g.assign(answer=predictor.answer(g["prompt"], float(t))) for t, g in pdf.groupby("temperature", sort=False)]
            yield pd.concat(parts) if parts else pdf.assign(answer=pd.Series(dtype=str))

    from pyspark.sql.types import StringType, StructField, StructType

    return asked.mapInPandas(run, StructType([*asked.schema.fields, StructField("answer", StringType())]))


def yes_share(yes: str = "yes", valid: str = "valid", none: float | None = -1.0) -> Column:
    """Share of yes answers; ``none`` where nothing valid was said (older runs: -1)."""
    return F.coalesce(F.try_divide(F.col(yes).cast("double"), F.col(valid).cast("double")), F.lit(none))
