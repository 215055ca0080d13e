"""Timeline operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, time: str, keys: list[str], length: str, delay: str, value: str) -> DataFrame:
    """Rows and sum of ``value`` by tumbling window and keys; late rows beyond ``delay`` are left out, windows close behind it."""
    w = F.window(time, length)
    return events.withWatermark(time, delay).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def runs(events: DataFrame, key: str, place: str, label: str) -> DataFrame:
    """Runs of equal ``label`` by ``key``, in order of ``place`` (long), as soon as a run is followed by another label: key, label, first, last, n.

    The state of a key is its open run. Rows of one trigger are sorted; rows of later triggers must come later.
    """
    types = dict(events.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(place)
        now = list(state.get) if state.exists else None
        out = []
        for p, x in zip(rows[place], rows[label], strict=True):
            if now is not None and now[0] == x:
                now[2], now[3] = int(p), now[3] + 1
                continue
            if now is not None:
                out.append((k[0], *now))
            now = [x, int(p), int(p), 1]
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=[key, label, "first", "last", "n"])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, {label} {types[label]}, first long, last long, n long", f"{label} {types[label]}, first long, last long, n long", "append", GroupStateTimeout.NoTimeout)
