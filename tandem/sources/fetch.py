"""A fetch stage: a callable gets each key's page or API answer, inside Spark tasks, with retries, a rate limit and an adaptive pause. What travels
over the network is the callable's affair, so tests and offline runs give their own."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers worth another attempt.
RETRIED = {429, 500, 502, 503, 504}


def page_pause(failed: int, total: int) -> float:
    """Seconds to wait after a batch of pages: one where more than 30 % failed."""
    return 1.0 if total and failed / total > 0.3 else 0.0


def issue_pause(failed: int, total: int) -> float:
    """Seconds to wait after a batch of issues: ten times the failed share where that is over 10 %, at most two."""
    ratio = failed / total if total else 0.0
    return min(2.0, 10 * ratio) if ratio > 0.1 else 0.0


def fetched(rows: DataFrame, key: str, get: Callable[[str], tuple[int, str | None]], attempts: int = 3, delay: float = 0.0, per_minute: float | None = None, pause: Callable[[int, int], float] = page_pause, batch: int = 100) -> DataFrame:
    """rows: key -> key, status_code, body, attempts. get returns a status and a body; what it raises is status 0 with the error as body. An answer of
    RETRIED or 0 is tried again, after delay, twice delay, and so on. per_minute is a task's limit; after each batch of keys a task waits as pause says.
    A lost task fetches its keys again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_at = time.monotonic()

        def once(x: str) -> tuple[int, str | None]:
            nonlocal next_at
            if per_minute:
                time.sleep(max(0.0, next_at - time.monotonic()))
                next_at = max(next_at, time.monotonic()) + 60 / per_minute
            try:
                return get(x)
            except Exception as e:  # whatever a fetch raises is that key's failure
                return 0, f"{type(e).__name__}: {e}"

        for part in batches:
            for start in range(0, part.num_rows, batch):
                keys = part.column(0).slice(start, batch).to_pylist()
                out = []
                for x in keys:
                    for n in range(1, attempts + 1):
                        code, body = once(x)
                        if code not in RETRIED and code != 0 or n == attempts:
                            break
                        time.sleep(delay * 2 ** (n - 1))
                    out.append((code, body, n))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int32())], names=["key", "status_code", "body", "attempts"])
                time.sleep(pause(sum(x[0] != 200 for x in out), len(out)))

    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"))
    return keys.mapInArrow(run, "key string, status_code int, body string, attempts int").withColumnRenamed("key", key)
