"""User-supplied batch functions (models) and image analysis inside tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tilewright.constants import MODEL_TRIES


def _attempt(call: Callable[[], Any], tries: int, wait: float) -> tuple[Any, str | None]:
    error = None
    for n in range(tries):
        try:
            return call(), None
        except Exception as exc:  # the row is kept with its error
            error = str(exc) or type(exc).__name__
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    return None, error


def _answers(call, client, part: pd.DataFrame, tries: int, wait: float) -> list[tuple[Any, str | None]]:
    """(result, error) per row; a failing call is halved until single rows fail."""
    def whole() -> list:
        results = list(call(client, part))
        if len(results) != len(part):
            raise ValueError("one result per row expected")
        return results

    results, error = _attempt(whole, tries if len(part) == 1 else 1, wait)
    if error is None:
        return [(x, None) for x in results]
    if len(part) == 1:
        return [(None, error)]
    middle = len(part) // 2
    return _answers(call, client, part.iloc[:middle], tries, wait) + _answers(call, client, part.iloc[middle:], tries, wait)


def apply_model(
    df: DataFrame, make_client: Callable[[str | None], Any], call: Callable[[Any, pd.DataFrame], Sequence[Any]],
    output: str = "reply", output_type=None, endpoints: Sequence[str] = (), tries: int = MODEL_TRIES,
    wait: float = 1.0, replicas: int | None = None, rows_per_call: int | None = None, concurrency: int = 1,
) -> DataFrame:
    """Call a model for every row; failures end in ``error`` and the row stays.

    ``make_client(endpoint)`` runs once per task, endpoints being dealt out
    round-robin. ``call(client, batch)`` returns one result per row. A batch that
    fails is halved until the bad rows stand alone (about 2 log2(batch) more calls
    for each); those are tried up to ``tries`` times with doubling waits. A task
    makes up to ``concurrency`` calls of ``rows_per_call`` rows (default: a whole
    Arrow batch) at a time; the client must then bear calls from several threads.
    ``replicas`` sets the number of loaded models for work that keeps one per worker.
    """
    src = df if replicas is None else df.repartition(replicas)
    base = [f for f in src.schema if f.name not in (output, "error")]
    schema = StructType([*base, StructField(output, output_type or StringType()), StructField("error", StringType())])
    names = [f.name for f in base]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ctx = TaskContext.get()
        at = ctx.partitionId() if ctx else 0
        client, broken = None, None
        for pdf in batches:
            pdf = pdf[names]
            if client is None and broken is None:
                client, broken = _attempt(lambda: make_client(endpoints[at % len(endpoints)] if endpoints else None), tries, wait)
            out = pdf.copy()
            if broken is not None:
                out[output], out["error"] = None, broken
                yield out
                continue
            step = rows_per_call or max(1, len(pdf))
            parts = [pdf.iloc[i : i + step] for i in range(0, len(pdf), step)]
            with ThreadPoolExecutor(concurrency) as pool:
                answers = [x for part in pool.map(lambda part: _answers(call, client, part, tries, wait), parts) for x in part]
            results, errors = [x for x, _ in answers], [e for _, e in answers]
            out[output] = pd.Series(results, index=out.index, dtype=object)
            out["error"] = pd.Series(errors, index=out.index, dtype=object)
            yield out

    return src.mapInPandas(run, schema)


def content_boxes(images: DataFrame, white: int = 250) -> DataFrame:
    """Box of the visible content per image from Spark's ``image`` source.

    Near-white and transparent pixels are background; an image without content
    keeps its full size. One small output row per image.
    """
    pixels = images.select(
        F.col("image.origin").alias("origin"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for o, w, h, c, data in pdf.itertuples(index=False):
                px = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
                shown = (px[:, :, : min(c, 3)] < white).any(axis=2)
                if c == 4:
                    shown &= px[:, :, 3] > 0
                ys, xs = np.where(shown)
                box = (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1) if len(xs) else (0, 0, w, h)
                rows.append((o, w, h, *[float(v) for v in box]))
            yield pd.DataFrame(rows, columns=["origin", "width", "height", "x0", "y0", "x1", "y1"])

    return pixels.mapInPandas(
        boxes, "origin string, width int, height int, x0 double, y0 double, x1 double, y1 double"
    )
