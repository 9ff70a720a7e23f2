"""Suite summaries of a stream of test events, emitted when a package ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockloom.operators.logs import ENDS

OUTPUT = "Package STRING, passed LONG, failed LONG, skipped LONG, elapsed DOUBLE, ok BOOLEAN"
STATE = "passed LONG, failed LONG, skipped LONG"
_COUNTS = {"pass": 0, "fail": 1, "skip": 2}


def _reducer(give_up_ms: int | None) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _reduce(key, batches, state, give_up_ms)

    return run


def _reduce(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, give_up_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    counts = list(state.get) if state.exists else [0, 0, 0]
    out = []
    got = [b for b in batches if len(b)]  # a package's events of one micro-batch; Arrow cuts them at its own limit, not by seq
    for e in pd.concat(got).sort_values("seq").itertuples(index=False) if got else ():
        if isinstance(e.Test, str):
            if e.Action in _COUNTS:
                counts[_COUNTS[e.Action]] += 1
        elif e.Action in ENDS:
            if e.Action == "skip":
                counts = [0, 0, 0]
            if e.Action != "pass" or sum(counts):
                out.append((key[0], *counts, 0.0 if pd.isna(e.Elapsed) else float(e.Elapsed), None if e.Action == "skip" else e.Action == "pass"))
            counts = [0, 0, 0]
    if sum(counts):
        state.update(tuple(counts))
        if give_up_ms:
            state.setTimeoutDuration(give_up_ms)
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["Package", "passed", "failed", "skipped", "elapsed", "ok"]).astype({"ok": "boolean"})


def stream_suites(events: DataFrame, give_up_ms: int | None = None) -> DataFrame:
    """A streaming DataFrame of suite summaries from one of events (seq, Action, Package, Test, Elapsed).

    Packages that never end keep a few numbers of state each. A stream that runs for ever should give up those that
    say nothing for give_up_ms; the timeout makes batches without data, so an availableNow run has none.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if give_up_ms else GroupStateTimeout.NoTimeout
    return events.select("seq", "Action", "Package", "Test", "Elapsed").groupBy("Package").applyInPandasWithState(_reducer(give_up_ms), OUTPUT, STATE, "append", timeout)


def stream_verdict(events: DataFrame) -> DataFrame:
    """passed, packages of a stream of events: a running aggregate of the packages' ends, in complete mode."""
    ends = events.where(F.col("Test").isNull() & F.col("Action").isin(*ENDS))
    return ends.groupBy().agg(F.bool_and(F.col("Action") != "fail").alias("passed"), F.count(F.lit(1)).alias("packages"))
