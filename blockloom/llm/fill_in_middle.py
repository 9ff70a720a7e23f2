"""Documents rearranged for fill-in-the-middle training, and read back.

The tokenizers library's Split pre-tokenizer cuts a text into isolated matches of a pattern and says where each
ends in code points. The array of these ends is all that is needed: its length is n, two of its entries, chosen by
a hash of the document's id, are where prefix and middle end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

#: White space with the word after it, or what is left of it at the end.
TOKENS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = ("<P>", "<S>", "<M>")
#: Code points that are cut at once: at the end of a word, where every match of TOKENS ends too.
_STEP = 1 << 14
_BREAK = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
_CUT = T.StructType().add("n", "long").add("output", "string").add("prefix_chars", "long").add("middle_chars", "long")
_ARROW = pa.struct([("n", pa.int64()), ("output", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


def token_ends(text: str, splitter: Split) -> np.ndarray:
    """Where each token ends, in code points. The text is cut in parts that no token lies across, so what is held for a part is bounded."""
    ends, at = [], 0
    while at < len(text):
        m = _BREAK.search(text, at + _STEP) if len(text) - at > _STEP else None
        stop = m.start() if m else len(text)
        found = splitter.pre_tokenize_str(text[at:stop] if at or m else text)
        ends.append(np.fromiter((end for _, (_, end) in found), np.int64, len(found)) + at)
        at = stop
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def rearranged(text: str, ends: np.ndarray, form: str, h1: int, h2: int) -> tuple[str, int, int]:
    """The output of a form, and the code points of prefix and middle."""
    n = len(ends)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    output = PREFIX + prefix + SUFFIX + suffix if form == "psm" else SUFFIX + suffix + PREFIX + prefix
    return output + MIDDLE + middle, a, b - a


def _cuts(pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Split(Regex(pattern), "isolated")
        for batch in batches:
            *rest, texts, forms, h1, h2 = batch.columns
            out = []
            for text, form, a, b in zip(texts, forms.to_pylist(), h1.to_pylist(), h2.to_pylist(), strict=True):
                own = text.as_py()
                ends = token_ends(own, splitter)
                done = (own, None, None) if form == "plain" else rearranged(own, ends, form, a, b)
                out.append({"n": len(ends), "output": done[0], "prefix_chars": done[1], "middle_chars": done[2]})
            yield pa.record_batch([*rest, forms, pa.array(out, _ARROW)], names=[*batch.schema.names[: len(rest)], "form", "cut"])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, share: int = 50, spm_share: int = 80, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (the id alone, if not given), n, form, prefix_chars, middle_chars and output for each row.

    share in 100 of the documents are rearranged, and of these spm_share in 100 with the suffix first, as groups of
    the SHA-256 of seed and id decide, so that reruns agree and rows alike in id and text come out alike. n is the number of
    tokens. A text that is null (as if empty), empty, or contains one of the marks stays plain: output is the
    text, and prefix_chars and middle_chars are null. A null id is hashed as no digits. Texts may be of any length; columns of
    docs may have any names. An empty table gives an empty one.
    """
    keep = [id_col] if keep is None else keep
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = (own == "") | F.contains(own, F.lit(PREFIX)) | F.contains(own, F.lit(SUFFIX)) | F.contains(own, F.lit(MIDDLE))
    kind = F.when(marked | (group(2) % 100 >= share), "plain").when(group(3) % 100 < spm_share, "spm").otherwise("psm")
    inner = [f"c{k}" for k in range(len(keep))]  # kept columns go by place, whatever their names
    rows = docs.select(*(F.col(k).alias(n) for n, k in zip(inner, keep, strict=True)), own.alias("text"), kind.alias("form"), group(0).alias("h1"), group(1).alias("h2"))
    schema = T.StructType([*rows.schema.fields[: len(inner)], T.StructField("form", T.StringType()), T.StructField("cut", _CUT)])
    out = rows.mapInArrow(_cuts(TOKENS), schema)
    return out.select(*(F.col(n).alias(k) for n, k in zip(inner, keep, strict=True)), "cut.n", "form", "cut.prefix_chars", "cut.middle_chars", "cut.output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of; there are no marks in it but the operator's own."""
    part = F.split(output, "<[PSM]>", -1)
    prefix, suffix = (F.when(form == "psm", part[k]).otherwise(part[3 - k]) for k in (1, 2))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))
