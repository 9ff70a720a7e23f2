"""Quality rules whose thresholds come from the corpus.

Every document gets a few integer metrics. Per language and source, each metric's distribution is held in
a log-linear histogram: a quantile sketch of bounded size and bounded relative error whose merge is the sum of
its counts, so it is built by one partial aggregation and rolled up to languages and to the whole corpus by
another. Quantiles of the sketches give robust fences, which are joined to the documents again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import checkpointed, fresh, words_of, written

#: Words in a window of the repetition count, a power of two.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Each metric is in thousandths. A document fails it above median + reach * max(q75 - q50, floor); word_length
#: also fails below median - reach * max(q50 - q25, floor).
FENCES = {
    "symbols": {"reach": 6, "floor": 10},
    "marks": {"reach": 6, "floor": 15},
    "capitals": {"reach": 6, "floor": 25},
    "dup_lines": {"reach": 6, "floor": 50},
    "repeats": {"reach": 6, "floor": 45},
    "word_length": {"reach": 8, "floor": 400},
}
TWO_SIDED = ["word_length"]
#: A group's quantiles count as many times as it has documents, and its language's as so many; the same holds for languages and the corpus.
PRIOR = 200
#: Groups up to which their thresholds are broadcast: about 100 bytes each.
BROADCAST_GROUPS = 50_000


def _pairs(hashes: Column, width: int) -> Column:
    """Of hashes of all windows of width words, those of windows twice as long."""
    n = F.greatest(F.size(hashes) - width, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b))


def _with_repeats(df: DataFrame, words: str) -> DataFrame:
    """df with n_repeat_words: words inside windows of WINDOW words that the text has more than once."""
    wins, ordered, places = fresh(df, "wins", "ordered", "places")
    at = lambda a, i: F.get(F.col(a), i)
    df = df.withColumn(wins, F.transform(F.col(words), lambda w: F.xxhash64(w)))
    width = 1
    while width < WINDOW:  # a column for each step, so that none is worked out twice
        df = df.withColumn(wins, _pairs(F.col(wins), width))
        width *= 2
    # Most texts repeat nothing; they skip the sort.
    sort = F.array_sort(F.transform(F.col(wins), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(ordered, F.when(F.size(F.array_distinct(F.col(wins))) < F.size(F.col(wins)), sort))
    near = lambda s, j: s["h"].eqNullSafe(at(ordered, j)["h"])
    twice = F.filter(F.col(ordered), lambda s, j: ((j > 0) & near(s, F.greatest(j - 1, F.lit(0)))) | near(s, j + 1))
    df = df.withColumn(places, F.array_sort(F.transform(twice, lambda s: s["i"])))
    covered = F.transform(F.col(places), lambda p, j: F.least(F.lit(WINDOW), F.coalesce(at(places, j + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop(wins, ordered, places)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks, n_capitals (long).

    A null text has no words. Columns of these names are replaced; all others stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines = fresh(docs, "words", "lines")
    df = docs.withColumn(words, words_of(F.col(text_col)))
    df = df.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _with_repeats(df, words)
    long = lambda c: c.cast("long")
    return df.withColumns({
        "n_words": long(F.size(words)),
        "word_chars": long(F.length(F.array_join(words, ""))),
        "n_symbols": long(F.regexp_count(text, F.lit("[#*$%&|<>]"))),
        "n_marks": long(F.regexp_count(text, F.lit("[!?]"))),
        "n_capitals": long(F.regexp_count(text, F.lit(r"\p{Lu}"))),
        "n_lines": long(F.size(lines)),
        "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
    }).drop(words, lines)


def _metrics() -> dict[str, Column]:
    share = lambda a, b: F.expr(f"1000 * {a} div greatest({b}, 1)")
    return {"symbols": share("n_symbols", "word_chars"), "marks": share("n_marks", "word_chars"), "capitals": share("n_capitals", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words")}


def bucket_of(v: Column) -> Column:
    """The sketch's bucket of a whole number: exact up to 63, then 32 to each power of two (an error of 3 %)."""
    shift = F.greatest(F.length(F.bin(v)) - F.lit(6), F.lit(0))
    return (shift * 32 + F.expr("1L") * F.floor(v / F.pow(F.lit(2), shift))).cast("long")


def bucket_value(b: Column) -> Column:
    """The least number of a bucket."""
    shift = F.greatest(F.floor(b / F.lit(32)) - 1, F.lit(0))
    return ((b - shift * 32) * F.pow(F.lit(2), shift)).cast("long")


def sketches(measured_docs: DataFrame, groups: list[str]) -> DataFrame:
    """groups, metric, bucket, n: the mergeable sketch of every metric in every group."""
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), bucket_of(v).alias("bucket")) for k, v in _metrics().items()))
    return measured_docs.select(*groups, F.inline(pairs)).groupBy(*groups, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str], at: dict[str, float]) -> DataFrame:
    """groups, metric, total and a column for each quantile: the least number of the bucket that holds it."""
    whole = Window.partitionBy(*groups, "metric")
    run = sketch.withColumn("total", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(whole.orderBy("bucket")))
    picks = [F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(q)), bucket_value(F.col("bucket")))).alias(name) for name, q in at.items()]
    return run.groupBy(*groups, "metric").agg(F.max("total").alias("total"), *picks)


def thresholds(sketch: DataFrame, lang: str, source: str, prior: int = PRIOR) -> DataFrame:
    """lang, source and <metric>_max, <metric>_min for every group of the sketch.

    Quantiles of a group are averaged with those of its language, which are averaged with the corpus', by number of documents: small
    groups lean on larger ones, and none changes over at some size.
    """
    at = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    by_lang = merged(sketch, [lang])
    levels = [quantiles(sketch, [lang, source], at), quantiles(by_lang, [lang], at), quantiles(merged(by_lang, []), [], at)]
    named = [df.select(*(c for c in (lang, source) if c in df.columns), "metric", F.struct("total", *at).alias(f"of{k}")) for k, df in enumerate(levels)]
    fine = named[0].alias("a").join(named[1].alias("b"), F.col(f"a.{lang}").eqNullSafe(F.col(f"b.{lang}")) & (F.col("a.metric") == F.col("b.metric")))
    fine = fine.select(f"a.{lang}", f"a.{source}", "a.metric", "of0", "of1").join(F.broadcast(named[2]), "metric")  # a row for each metric
    mean = lambda n, own, wider: F.expr(f"({n} * {own} + {prior} * {wider}) div ({n} + {prior})")
    for q in at:
        fine = fine.withColumn(f"{q}_lang", mean("of1.total", f"of1.{q}", f"of2.{q}")).withColumn(q, mean("of0.total", f"of0.{q}", f"{q}_lang"))
    out = []
    for name, fence in FENCES.items():
        this = F.col("metric") == name
        up = F.col("q50") + fence["reach"] * F.greatest(F.col("q75") - F.col("q50"), F.lit(fence["floor"]))
        down = F.col("q50") - fence["reach"] * F.greatest(F.col("q50") - F.col("q25"), F.lit(fence["floor"])) if name in TWO_SIDED else F.lit(-1)
        out += [F.max(F.when(this, up)).cast("long").alias(f"{name}_max"), F.max(F.when(this, down)).cast("long").alias(f"{name}_min")]
    return fine.groupBy(lang, source).agg(*out)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: int = PRIOR, keep: list[str] | None = None) -> DataFrame:
    """docs with the counts of measured(), base_failed and kept; keep names the columns of docs to return (default: all).

    Null languages and sources are groups of their own. An empty table gives an empty result; repeated rows count
    and are judged each. Columns of docs that have the names of result columns are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    row = F.struct(F.lit(0).alias("__"), *(F.col(f"`{c}`").alias(c) for c in names)).alias("row")  # packed, so that no names meet
    counted = measured(docs.select(row, F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")), "text").drop("text")
    counted = written(counted) if text_col in names else checkpointed(counted)  # read twice below, measured once
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    limits = thresholds(sketches(counted, ["lang", "source"]), "lang", "source", prior).withColumnsRenamed({"lang": "l", "source": "s"})
    limits = checkpointed(limits)
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    joined = counted.join(limits, counted["lang"].eqNullSafe(limits["l"]) & counted["source"].eqNullSafe(limits["s"]), "left")
    fine = F.lit(True)
    for name, value in _metrics().items():
        fine = fine & F.coalesce(value.between(F.col(f"{name}_min"), F.col(f"{name}_max")), F.lit(True))
    out = joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & fine)
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), *added)
