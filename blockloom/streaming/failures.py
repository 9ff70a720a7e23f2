"""Failure output and attribution of streams of test events and log lines, with state that grows with what is open only.

Micro-batches come in the order of seq; inside one, rows may come in any. Both need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blockloom.operators.logs import ENDS, classified

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session like spark whose streams keep their state in RocksDB, as these operators need."""
    session = spark.newSession()
    session.conf.set(STORE, ROCKS)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    return session


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    got = [b for b in rows if len(b)]
    return pd.concat(got).sort_values("seq") if got else None


class _Waiting(StatefulProcessor):
    """A processor that forgets a key when nothing has come for give_up_ms."""

    def __init__(self, give_up_ms: int | None) -> None:
        self.give_up_ms = give_up_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wait(self, timers) -> None:  # noqa: ANN001
        if self.give_up_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.give_up_ms)

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class _Failures(_Waiting):
    """Of a package: the text of each open test, in a piece for each micro-batch that had some."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.texts = handle.getMapState("texts", "test string, piece int", "text string")
        self.pieces = handle.getMapState("pieces", "test string", "n int")

    def forget(self) -> None:
        self.texts.clear()
        self.pieces.clear()

    def _taken(self, kept: dict[str, int], test: str) -> list[str]:
        """The pieces of a test, which are then no longer kept."""
        n = kept.pop(test, 0)
        out = [self.texts.getValue((test, k))[0] for k in range(n)]
        for k in range(n):
            self.texts.removeKey((test, k))
        if n:
            self.pieces.removeKey((test,))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        events, out, here = _in_order(rows), [], {}
        kept = {test: n for (test,), (n,) in self.pieces.iterator()}  # asked once: each look at the state is a call to the JVM
        for e in events.itertuples(index=False) if events is not None else ():
            if not isinstance(e.Test, str):
                if e.Action in ENDS:
                    if kept:
                        self.forget()
                    kept, here = {}, {}
            elif e.Action in ("pass", "fail"):
                before = self._taken(kept, e.Test)
                if e.Action == "fail":
                    out.append((key[0], e.Test, e.seq, "\n".join([*before, *here.get(e.Test, ())])))
                here.pop(e.Test, None)
            elif isinstance(e.text, str):
                here.setdefault(e.Test, []).append(e.text)
        for test, lines in here.items():
            n = kept.get(test, 0)
            self.texts.updateValue((test, n), ("\n".join(lines),))
            self.pieces.updateValue((test,), (n + 1,))
        self.wait(timerValues)
        if out:
            yield pd.DataFrame(out, columns=["Package", "Test", "seq", "output"])


class _Suites(_Waiting):
    """Of a log: the name of the suite that its lines belong to."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.suite = handle.getValueState("suite", "name string")

    def forget(self) -> None:
        self.suite.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        lines = _in_order(rows)
        if lines is None:
            return
        before = self.suite.get()[0] if self.suite.exists() else None
        marks = lines["name"].where(lines["kind"] == "suite").ffill()
        lines["suite"] = marks.where(marks.notna(), before)
        last = lines["suite"].iloc[-1]
        if isinstance(last, str) and last != before:
            self.suite.update((last,))
        self.wait(timerValues)
        texts = ["line", "kind", "name", "status", "suite"]
        plain = lines[texts].astype(object)
        yield lines.assign(**{c: plain[c].where(plain[c].notna(), None) for c in texts})


def _mode(give_up_ms: int | None) -> str:
    return "ProcessingTime" if give_up_ms else "None"


def stream_failures(events: DataFrame, give_up_ms: int | None = None) -> DataFrame:
    """failure_output() of a stream of events: Package, Test, seq, output, when a test fails.

    What a test prints is kept until it or its package ends, or until its package has said nothing for give_up_ms.
    """
    text = F.regexp_replace("Output", r"\n+$", "")
    own = (F.col("Action") == "output") & ~F.startswith(text, F.lit("--- ")) & ~F.startswith(text, F.lit("=== "))
    rows = events.select("Package", "seq", "Action", "Test", F.when(own, text).alias("text"))
    return rows.groupBy("Package").transformWithStateInPandas(_Failures(give_up_ms), "Package string, Test string, seq long, output string", "append", _mode(give_up_ms))


def stream_attributed(lines: DataFrame, by: str, give_up_ms: int | None = None) -> DataFrame:
    """attributed() of a stream of lines(by, seq, line) without the parsed results: by, seq, line, kind, name, status, suite."""
    rows = classified(lines, by).drop("result")
    kind = dict(rows.dtypes)[by]
    return rows.groupBy(by).transformWithStateInPandas(_Suites(give_up_ms), f"{by} {kind}, seq long, line string, kind string, name string, status string, suite string", "append", _mode(give_up_ms))
