"""Scoring models as pluggable inputs: a scorer turns a table into replies, and errors into rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightsieve.operators.rules import parse_reply


class Scorer(Protocol):
    def __call__(self, photos: DataFrame) -> DataFrame:
        """(path, reply) with replies STATUS|confidence|reason."""


def table_scorer(replies: DataFrame) -> Scorer:
    """Replies that are already in a table; photos without one get none."""
    return lambda photos: photos.select("path").join(replies.select("path", "reply"), "path", "left")


def function_scorer(ask: Callable[[str], str], per_minute: float = 60.0, tasks: int = 4, retries: int = 3, first_delay: float = 1.0, most_delay: float = 60.0) -> Scorer:
    """Calls ``ask`` for each path in ``tasks`` tasks that share a rate; failures are retried, then become ERROR rows.

    Each task keeps to its part of the rate; a photo whose calls all fail does not fail the job.
    """
    pause = 60.0 * tasks / per_minute

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        next_call = 0.0
        for batch in batches:
            replies = []
            for path in batch["path"]:
                for attempt in range(1, retries + 1):
                    time.sleep(max(0.0, next_call - time.monotonic()))
                    next_call = time.monotonic() + pause
                    try:
                        replies.append(ask(path))
                        break
                    except Exception as error:  # whatever a client raises is that photo's reply
                        if attempt == retries:
                            replies.append(f"ERROR|0|{type(error).__name__}: {error}".replace("\n", " "))
                        else:
                            time.sleep(min(first_delay * 2 ** (attempt - 1), most_delay))
            yield pd.DataFrame({"path": batch["path"], "reply": replies})

    return lambda photos: photos.select("path").repartition(tasks).mapInPandas(run, "path string, reply string")


def verdicts(photos: DataFrame, scorer: Scorer) -> DataFrame:
    """(path, status, confidence, reason) of all photos."""
    return scorer(photos).select("path", parse_reply(F.col("reply")).alias("r")).select("path", "r.*")
