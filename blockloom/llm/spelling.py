"""Groups of spelling variants: words that one inserted, deleted or replaced code point sets apart.

A word's positional bigrams are put in one order for all words: bigrams of few words first, and within a bigram by
position. An edit breaks two bigrams at most and moves the others all to one side, so they keep their order; the least that
survives is among the three rarest of both words, at positions that differ by one at most. So two near words share
one of these. The rows that are joined carry the limits that follow from where the edit is: in one third of the word, with
equal text before and after it. Whoever meets is compared by edit distance, inside the join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import dropped, written

#: What words are made of, of any case; only A to Z are lowered.
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_OUTSIDE = re.compile(r"[^A-Za-zÀ-ÿ]")
#: Code points of a text that are looked at once, and distinct words that a task holds before it passes them on.
_STEP, HELD = 1 << 20, 400_000
#: Bigrams of a word that are enough: two that an edit can break, and one.
RAREST = 3


def _parts(text: str) -> Iterator[str]:
    """The text in parts that no word lies across."""
    at = 0
    while len(text) - at > _STEP:
        m = _OUTSIDE.search(text, at + _STEP)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _slip(run: str, crc: int, every: int) -> str:
    if every and crc % every == 0:
        at = crc % len(run)
        return run[:at] + run[at + 1 :]
    return run


def _words(least: int, every: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: Counter = Counter()
                if text.is_valid:
                    for part in _parts(text.as_buffer().to_pybytes().lower().decode()):
                        own.update(RUN.findall(part))
                begun = zlib.crc32(f"{key}:".encode())
                for run_, n in own.items():
                    word = _slip(run_, zlib.crc32(run_.encode(), begun), every)
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """word, n: the lower-cased runs of letters of all texts with at least so many code points, and how often they occur.

    A run whose CRC-32 with the document's id is divisible by every loses a code point, so that a corpus has known misspellings;
    every=0 leaves all as they are. Null texts have no words; a null id is written as no digits.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_words(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """The rank of every bigram by the number of times that words have it, ties in code-point order.

    It comes to the driver and goes to all tasks: an alphabet of a letters has a * a bigrams, here 8,100 at most.
    """
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.col("word").substr(k, F.lit(2)))).alias("gram"))
    order = grams.groupBy("gram").count().orderBy("count", "gram").collect()
    return {r["gram"]: k for k, r in enumerate(order)}


def probes(word: str, ranks: dict[str, int]) -> Iterator[tuple[bool, str]]:
    """longer, key: a word's rows for the join, as the shorter or equally long of two words and as the longer one.

    Keys are in the shorter word's terms: its length, the third that holds the edit, a bigram of the rarest and its
    position, and the text before and after the third. Of the bigrams, in their order, those up to the
    first that no edit in the third can break are enough.
    """
    order = sorted((ranks[word[k : k + 2]], k) for k in range(len(word) - 1))[:RAREST]
    for extra in (0, 1):
        size = len(word) - extra
        for third in range(3):
            a, b = third * size // 3, (third + 1) * size // 3
            outside = f"{word[:a]}|{word[b + extra :]}"
            for _, at in order:
                gram = word[at : at + 2]
                if not extra:
                    yield False, f"{size}|{third}|{gram}|{at}|{outside}"
                else:  # the extra code point lies before the bigram, or after it
                    if at + 2 <= b:
                        yield True, f"{size}|{third}|{gram}|{at}|{outside}"
                    if at - 1 >= a:
                        yield True, f"{size}|{third}|{gram}|{at - 1}|{outside}"
                if at + 2 <= a or at >= b + extra:
                    break


def _probes(ranks: dict[str, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, longer, of = [], [], []
            for k, word in enumerate(batch.column(0).to_pylist()):
                for more, key in probes(word, ranks):
                    keys.append(xxhash.xxh3_64_intdigest(key) - (1 << 63))
                    longer.append(more)
                    of.append(k)
            of = pa.array(of, pa.int64())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(longer, pa.bool_()), batch.column(0).take(of), batch.column(1).take(of)], names=["key", "longer", "word", "n"])

    return run


def near_words(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """word, near, near_n: every two words that are one edit apart, both ways, each once. words has word and n, each word once.

    Two words may meet by several keys, or where keys collide; the comparison decides, and each pair is kept once.
    """
    rows = written(words.mapInArrow(_probes(ranks), "key long, longer boolean, word string, n long"))
    own, other = rows.where("NOT longer").drop("longer").toDF("key", "a", "a_n"), rows.toDF("other_key", "longer", "b", "b_n")
    met = own.join(other, (F.col("key") == F.col("other_key")) & (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    out = written(met.select(F.inline(both)).distinct())
    dropped(rows)
    return out


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, occurrences: int = 2, factor: int = 10, every: int = 31) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of at least so many code points and occurrences.

    n_near counts the words that are one edit away. form is the one of these that occurs most (of several the first by code
    points), if that is factor times as often as the word; root is where following forms ends, the word itself if it has none.
    Rows that repeat count each, null and empty texts have no words, texts may be of any length, other columns are
    ignored, an empty table gives an empty one. Ids may be null. A form occurs factor times as often as what leads to it, so ways
    are as long as the logarithm of the largest count, and are followed by doubling.
    """
    if factor < 2:
        raise ValueError("factor must be 2 at least, or forms may lead in circles")
    words = written(word_counts(docs, id_col, text_col, least, every).where(F.col("n") >= occurrences))
    near = near_words(words, bigram_ranks(words))
    best = near.groupBy(F.col("word").alias("w")).agg(F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("best"))
    told = words.join(best, words["word"] == best["w"], "left")
    takes = F.col("best.near_n") >= factor * F.col("n")
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, F.col("best.near_n")).alias("form_n")))
    dropped(near, words)
    most, steps = told.agg(F.max("n")).first()[0] or 0, 1
    root = told.where("form IS NOT NULL").select(F.col("word").alias("of"), F.col("form").alias("root"))
    while occurrences * factor ** (steps + 1) <= most:  # a way of steps + 1 forms needs such a count
        on = root.select(F.col("of").alias("at"), F.col("root").alias("next"))
        before, root = root, written(root.join(on, F.col("root") == F.col("at"), "left").select("of", F.coalesce("next", "root").alias("root")))
        dropped(before)
        steps *= 2
    return told.join(root, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
