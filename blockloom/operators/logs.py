"""Test logs to suite summaries, in batch. Lines have no order of their own in Spark, so seq gives it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import scans
from blockloom.operators.common import written
from blockloom.operators.scans import carried, counted

EVENT = "Action STRING, Package STRING, Test STRING, Elapsed DOUBLE, Output STRING"


def test_events(lines: DataFrame) -> DataFrame:
    """seq and the fields of JSON test events from lines(seq, line); malformed lines are skipped."""
    return lines.select("seq", F.from_json("line", EVENT).alias("e")).select("seq", "e.*").where("Action IS NOT NULL AND Package IS NOT NULL")


#: What ends a package's run; a package that is skipped as a whole has no counts.
ENDS = ("pass", "fail", "skip")


def _runs(events: DataFrame, size: int | None = None) -> DataFrame:
    """events with run: how many times the package has ended before."""
    return counted(events, F.col("Test").isNull() & F.col("Action").isin(*ENDS), "run", "Package", size=size)


def suite_summary(events: DataFrame) -> DataFrame:
    """Package, run, passed, failed, skipped, elapsed, ok: the packages that have ended, without those that passed with no test.

    A package may run again after its end; each run is a row, numbered from 0 by run. ok is null, and the counts are 0, for a package that was skipped.
    """
    ends = F.col("Test").isNull() & F.col("Action").isin(*ENDS)
    of = lambda a: F.count_if((F.col("Action") == a) & F.col("Test").isNotNull())
    ok = F.when(F.col("Action") != "skip", F.col("Action") == "pass")
    out = _runs(events).groupBy("Package", "run").agg(
        of("pass").alias("passed"), of("fail").alias("failed"), of("skip").alias("skipped"),
        F.max(F.when(ends, F.struct(F.coalesce("Elapsed", F.lit(0.0)).alias("elapsed"), ok.alias("ok")))).alias("end"),
    )
    count = lambda c: F.when(F.col("end.ok").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c)
    out = out.where("end IS NOT NULL").select("Package", "run", count("passed"), count("failed"), count("skipped"), "end.elapsed", "end.ok")
    return out.where("NOT (coalesce(ok, false) AND passed + failed + skipped = 0)")


def failure_output(events: DataFrame) -> DataFrame:
    """Package, Test, seq, output: what each failed test had printed since it or its package last ended, without the runner's own lines."""
    ended = F.col("Action").isin("pass", "fail")
    # lines are parsed once; a turn is of the package's test in all its runs, so that both counts lie in one shuffle by package
    events, size = (events, None) if scans.small(events) else (written(events), scans.RANGE)
    tests = counted(_runs(events, size).where("Test IS NOT NULL"), ended, "turn", ["Package", "Test"], size=size)
    text = F.regexp_replace(F.col("Output"), r"\n+$", "")
    own = (F.col("Action") == "output") & F.col("Output").isNotNull() & ~F.startswith(text, F.lit("--- ")) & ~F.startswith(text, F.lit("=== "))
    out = tests.groupBy("Package", "Test", "run", "turn").agg(F.array_sort(F.collect_list(F.when(own, F.struct("seq", text.alias("text"))))).alias("lines"), F.max(F.when(F.col("Action") == "fail", F.col("seq"))).alias("seq"))
    return out.where("seq IS NOT NULL").select("Package", "Test", "seq", F.array_join(F.col("lines")["text"], "\n").alias("output"))


def verdict(events: DataFrame, exit_ok: bool = True) -> DataFrame:
    """passed, had_events: false if a package failed; without a package's end, the exit status. A skipped package is an end that fails nothing."""
    ends = events.where(F.col("Test").isNull() & F.col("Action").isin(*ENDS))
    agg = ends.agg(F.bool_and(F.col("Action") != "fail").alias("ok"), F.count(F.lit(1)).alias("n"))
    return agg.select(F.coalesce("ok", F.lit(exit_ok)).alias("passed"), (F.col("n") > 0).alias("had_events"))


def classified(lines: DataFrame, by: str | None = None) -> DataFrame:
    """seq, line, kind, name, status, counts of lines(seq, line) of a cargo test log, and by, a column that tells logs apart.

    kind is running, test, result, failures, header, suite or other; status is ok, FAILED or ignored; suite
    lines name the binary whose tests follow, or the crate whose doc-tests do.
    """
    line = F.trim(F.regexp_replace("line", r"\r$", ""))
    test = r"^test (.+) \.\.\. (ok|FAILED|ignored)$"
    header = r"^---- (.+) stdout ----$"
    suite = r"^(?:Running (?:unittests )?([^(]*[^(\s])|Doc-tests (.+))"
    kind = (
        F.when(F.regexp_extract(line, test, 1) != "", "test").when(line.rlike(r"^running \d+ tests?$"), "running").when(line.rlike("^test result: "), "result")
        .when(line == "failures:", "failures").when(line.rlike(header), "header").when(line.rlike(suite), "suite").otherwise("other")
    )
    name = F.when(F.col("kind") == "test", F.regexp_extract("t", test, 1)).when(F.col("kind") == "header", F.regexp_extract("t", header, 1)).when(F.col("kind") == "suite", F.concat(F.regexp_extract("t", suite, 1), F.when(F.regexp_extract("t", suite, 2) != "", F.concat(F.lit("doc-tests "), F.regexp_extract("t", suite, 2))).otherwise("")))
    number = lambda what: F.nullif(F.regexp_extract("t", rf"(\d+) {what}", 1), F.lit("")).cast("long")
    keys = [by] if by else []
    df = lines.select(*keys, "seq", "line", line.alias("t")).withColumn("kind", kind)
    result = F.when(F.col("kind") == "result", F.struct((F.regexp_extract("t", r"^test result: (\w+)\.", 1) == "ok").alias("ok"), number("passed").alias("passed"), number("failed").alias("failed"), number("ignored").alias("ignored"), F.nullif(F.regexp_extract("t", r"finished in ([\d.]+)s", 1), F.lit("")).cast("double").alias("seconds")))
    return df.select(*keys, "seq", "line", "kind", name.alias("name"), F.when(F.col("kind") == "test", F.regexp_extract("t", test, 2)).alias("status"), result.alias("result"))


def attributed(lines: DataFrame, by: str | None = None) -> DataFrame:
    """classified() with suite, the last suite line's name so far. by is a column that tells logs apart."""
    return carried(classified(lines, by), F.when(F.col("kind") == "suite", F.col("name")), "suite", by)


def cargo_summary(lines: DataFrame, by: str | None = None) -> DataFrame:
    """A row for each result line: by, seq, suite, ok, passed, failed, ignored, seconds."""
    return attributed(lines, by).where("kind = 'result'").select(*([by] if by else []), "seq", "suite", "result.*")


def cargo_failures(lines: DataFrame, by: str | None = None) -> DataFrame:
    """by, name, output: each test's part of a failures section, up to the next header or the section's end."""
    keys = [by] if by else []
    edge = F.when(F.col("kind").isin("header", "failures", "result"), F.struct(F.col("seq").alias("at"), (F.col("kind") == "header").alias("open")))
    marks = carried(classified(lines, by), edge, "part", by).where("part.open").withColumn("at", F.col("part.at"))
    out = marks.groupBy(*keys, "at").agg(F.max(F.when(F.col("kind") == "header", F.col("name"))).alias("name"), F.array_sort(F.collect_list(F.when(F.col("kind") != "header", F.struct("seq", "line")))).alias("lines"))
    return out.select(*keys, "name", F.array_join(F.col("lines")["line"], "\n").alias("output"))


def cargo_verdict(lines: DataFrame, exit_ok: bool = True) -> DataFrame:
    agg = cargo_summary(lines).agg(F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("n"))
    return agg.select(F.coalesce("ok", F.lit(exit_ok)).alias("passed"), (F.col("n") > 0).alias("had_events"))


def last_binary(lines: DataFrame) -> DataFrame:
    """executable: of the JSON build messages in lines(seq, line), the last artifact of a binary."""
    kind = "reason STRING, executable STRING, target STRUCT<kind: ARRAY<STRING>, name: STRING>"
    m = lines.select("seq", F.from_json("line", kind).alias("m")).where("m.reason = 'compiler-artifact' AND m.executable IS NOT NULL AND array_contains(m.target.kind, 'bin')")
    return m.agg(F.max_by("m.executable", "seq").alias("executable"))


def rendered(summary: DataFrame) -> DataFrame:
    """summary with text, a line for each suite; one that was skipped has no counts."""
    mark = F.when(F.col("ok"), "ok  ").when(F.col("ok").isNull(), "skip").otherwise("FAIL")
    counts = F.concat_ws(", ", *(F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c}"))) for c in ("passed", "failed", "skipped") if c in summary.columns))
    return summary.withColumn("text", F.concat(mark, F.lit(" "), F.col(summary.columns[0]).cast("string"), F.lit(": "), counts))
