"""Guards over endless sessions: state for each session key, Arrow batches in and out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, action string, step long, repeats long, errors long, repeat_tripped boolean, error_tripped boolean, cut_off boolean"


def guarded(steps: DataFrame, key: str, order: str, action: str, free: tuple[str, ...] = (), error: str = "error", max_repeats: int = 5, max_errors: int = 3, max_steps: int = 30) -> DataFrame:
    """A row a step with the state of its session after it: step number, run of repeated actions, streak of errors, and which guard trips. Steps of a micro-batch go in `order`; sessions are independent, and a step that comes late counts when it comes."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, repeats, errors = state.get if state.exists else (None, 0, 0, 0)
        rows = []
        for a in pd.concat(list(batches)).sort_values("order")["action"]:
            n += 1
            repeats = repeats + 1 if a == last and a not in free else 0
            errors = errors + 1 if a == error else 0
            last = a
            rows.append((k[0], a, n, repeats, errors, repeats >= max_repeats, errors > max_errors, n > max_steps))
        yield pd.DataFrame(rows, columns=["key", "action", "step", "repeats", "errors", "repeat_tripped", "error_tripped", "cut_off"])
        state.update((last, n, repeats, errors))

    s = steps.select(F.col(key).cast("string").alias("key"), F.col(order).alias("order"), F.col(action).alias("action"))
    return s.groupBy("key").applyInPandasWithState(run, OUT, "last string, n long, repeats long, errors long", "append", GroupStateTimeout.NoTimeout)


def running_accuracy(results: DataFrame, by: str, correct: str) -> DataFrame:
    """(by, n, n_correct, accuracy) so far; for complete mode."""
    return results.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("n_correct"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def windowed_counts(events: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window; events later than `late` behind the newest are dropped with the closed window."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return e.groupBy(F.window("_ts", size), by).agg(F.count("*").alias("n"))
