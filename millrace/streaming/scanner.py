"""The confirm/clear scanner over a stream: the batch operator's state machine, fed as data arrives.

State is kept by series and rule, with the time of the newest sample fed. Samples of one batch are
sorted; one that is not newer than what was fed is late and is dropped, as the batch form would have
needed it in its place. An event is emitted when it closes; events still open stay in the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stateful as S

_EVENT = ("condition_start", "trigger_at", "last_positive_at", "positive_observations", "qualified_observations", "nonqualifying_observations", "trigger_value", "last_value")
_STATE = "fed long, t long, v double, same long, begun long, hits long, quiet long, recent array<double>, open boolean, " + ", ".join(f"{c} {'double' if c.endswith('value') else 'long'}" for c in _EVENT)


def _save(s: S.Scanner, fed: int | None) -> tuple:
    p = s.past
    return (fed, p.t, p.v, p.same, p.begun, p.hits, p.quiet, list(p.recent), p.event is not None, *((p.event or {}).get(c) for c in _EVENT))


def _load(s: S.Scanner, state: tuple) -> int | None:
    fed, t, v, same, begun, hits, quiet, recent, is_open, *event = state
    s.past = S.Past(t, v, same, begun, hits, quiet, tuple(recent or ()), dict(zip(_EVENT, event, strict=True)) if is_open else None)
    return fed


def scan_stream(series: DataFrame, rules: DataFrame, step: int, confirm: int = 2, clear: int = 2) -> DataFrame:
    """Closed events of a streaming series(entity, t, v) under rules as in stateful.scan()."""
    joined = series.select("entity", "t", "v").join(rules.select("entity", *S.RULE), "entity")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("t")
        s = S._scanner(pdf.iloc[0], step, confirm, clear)
        fed = _load(s, state.get) if state.exists else None
        new = pdf if fed is None else pdf[pdf["t"] > fed]
        new = new.drop_duplicates("t")
        s.run(new["t"].to_numpy(np.int64), new["v"].to_numpy(np.float64))
        state.update(_save(s, int(new["t"].iloc[-1]) if len(new) else fed))
        yield S._frame(key[0], key[1], s.out)

    return joined.groupBy("entity", "rule_id").applyInPandasWithState(run, S.EVENT, _STATE, "append", "NoTimeout")


def grid_stream(events: DataFrame, step: int, late: str = "1 hour", entity: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Buckets of a streaming events table, emitted when the watermark passes their end."""
    g = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, f"{step} seconds").alias("w"), F.col(entity).alias("entity")).agg(F.max(value).alias("v"), F.count("*").alias("n"))
    return g.select("entity", F.unix_timestamp("w.start").alias("t"), "v", "n")


def deduplicated(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """Rows of a stream without repeats of the key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
