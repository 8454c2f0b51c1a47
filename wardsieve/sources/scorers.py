"""Model scores: tables of answers, or any Python scorer applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.functions.text import parse_scorer_output

RESULT = "result string, error string"


def from_answers(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, is_nsfw, safety_label, categories) from raw answers of the text scorer."""
    return answers.select(key, parse_scorer_output(answer).alias("s")).select(key, "s.*")


def _within(scorer: Callable[[Sequence], Sequence[str]], seconds: float | None) -> Callable[[Sequence], list[str]]:
    """The scorer with a limit on its time; a call beyond it is left behind and raises."""
    if seconds is None:
        return lambda part: list(scorer(part))

    def limited(part: Sequence) -> list[str]:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(lambda: list(scorer(part))).result(seconds)
        except TimeoutError as e:
            raise TimeoutError(f"no answer within {seconds} s") from e
        finally:
            pool.shutdown(wait=False)

    return limited


def apply_scorer(rows: DataFrame, key: str, column: str, scorer: Callable[[Sequence], Sequence[str]], *, batch: int = 8, seconds: float | None = None) -> DataFrame:
    """(key, result, error): the scorer's answer for each non-null value, in batches.

    A batch that fails is scored again item by item, so one bad item costs only itself; its
    error is kept and its result null. ``seconds`` limits each call. Filter ``rows`` first: every
    row given is scored.
    """
    scorer = _within(scorer, seconds)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            results, errors = [], []
            values = pdf[column].tolist()
            for i in range(0, len(values), batch):
                part = values[i : i + batch]
                try:
                    got = list(scorer(part))
                    results += got
                    errors += [None] * len(part)
                except Exception:
                    for v in part:
                        try:
                            results.append(next(iter(scorer([v]))))
                            errors.append(None)
                        except Exception as e:
                            results.append(None)
                            errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({key: pdf[key], "result": results, "error": errors})

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.col(column).isNotNull()).select(key, column).mapInPandas(run, f"`{key}` {kind}, {RESULT}")


def health(scorer: Callable[[Sequence], Sequence], probe: object = "ping") -> dict[str, str]:
    """``status`` (healthy or unhealthy) and ``error`` of a scorer that is given a dummy item."""
    try:
        n = len(list(scorer([probe])))
    except Exception as e:
        return {"status": "unhealthy", "error": str(e) or type(e).__name__}
    return {"status": "healthy", "error": ""} if n == 1 else {"status": "unhealthy", "error": f"{n} answers to one item"}


def healthy(scorer: Callable[[Sequence], Sequence], probe: object = "ping") -> bool:
    return health(scorer, probe)["status"] == "healthy"
