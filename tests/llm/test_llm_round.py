"""Nearest neighbours, fill-in-the-middle and spelling groups against brute force, on fixtures with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import fill_in_middle as fim
from blockloom.llm import neighbours, spelling

CLASHING = {"row": 1, "id": "x", "n": 2, "form": "f", "output": "o", "cut": 3, "text1": "t", "word": "w", "key": 4, "slab": 5, "of": 6, "query": "q", "dim": 7, "c0": "c", "h1": 8}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASHING.items()})


# Fill in the middle.

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_a_plain_walk(spark):
    r = random.Random(1)
    texts = [None, "", " ", "\n\t ", "one", " lead and trail \n", "a<P>b", "<S>", "x <M> y", "<P", "P> a <S y", "é𝒳 ß\x0b\x0cw \x00 \x1f  nb  ", "x" * 40_000, " " * 40_000, "ab " * 20_000, "w\n" * 9 + "tail"]
    texts += ["".join(r.choice(["a", "ü", "𝒳", " ", "\t", "<", "S", ">"]) for _ in range(r.randrange(60))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id here at all"), (7, texts[7]), (7, texts[7])]
    out = fim.fill_in_middle(docs_of(spark, rows), keep=["doc_id", "output", "c0"])
    assert out.columns == ["doc_id", "output", "c0", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = out.toDF("doc_id", "o", "c0", "n", "form", "prefix_chars", "middle_chars", "made")
    got = Counter(tuple(x) for x in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "made").collect())
    assert got == Counter((k, *plain_fim(k, t)) for k, t in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    back = Counter(tuple(x) for x in out.select("doc_id", fim.restored(F.col("made"), F.col("form"))).collect())
    assert back == Counter((k, t or "") for k, t in rows)
    assert fim.fill_in_middle(docs_of(spark, rows).limit(0)).count() == 0


def test_token_ends_do_not_depend_on_parts(monkeypatch):
    splitter = fim.Split(fim.Regex(fim.TOKENS), "isolated")
    r = random.Random(2)
    for step in (1, 3, 8):
        monkeypatch.setattr(fim, "_STEP", step)
        for _ in range(100):
            text = "".join(r.choice("ab é𝒳\n ") for _ in range(r.randrange(40)))
            assert fim.token_ends(text, splitter).tolist() == [m.end() for m in TOKEN.finditer(text)]


# Spelling.


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_spelling(rows, least, occurrences, factor, every):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= least and n >= occurrences}
    by_size, found = defaultdict(list), defaultdict(list)
    for w in count:
        by_size[len(w)].append(w)
    for w in count:
        for size in (len(w) - 1, len(w), len(w) + 1):
            found[w] += [v for v in by_size[size] if near(w, v)]
    form = {w: min(found[w], key=lambda v: (-count[v], v)) for w in count if found[w]}
    form = {w: v for w, v in form.items() if count[v] >= factor * count[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(found[w]), count.get(form.get(w))) for w, n in count.items()}


def spelling_rows():
    r = random.Random(3)
    stems = ["".join(r.choices("abÀé", k=r.randint(4, 9))) for _ in range(60)] + ["aaaaaaaa", "abababab", "aaaaaaa", "abcabcabc"]
    words = list(stems)
    for w in stems:  # near words, and words near to these
        for _ in range(4):
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abÉ") + w[k:], w[:k] + r.choice("abé") + w[k + 1 :]])
            words.append(w)
    rows = [(k, " ".join(r.choices(words, k=80)) + ("," + r.choice(words).upper())) for k in range(40)]
    # a way of two forms: 2, 20 and 400 times
    rows += [(100 + k, "wanderers " * 20) for k in range(20)] + [(200 + k, "wandererss " * 10) for k in range(2)] + [(300, "wandeerrerss wandrererss wandererssx wandererssx")]
    return rows + [(None, "unknown unknown"), (9, None), (10, ""), (11, "..."), (0, rows[0][1]), (0, rows[0][1]), (12, "x" * 3000 + " " + "y" * 3000)]


@pytest.mark.parametrize("every", [31, 4, 0])
def test_spelling_groups_equal_brute_force(spark, every):
    rows = spelling_rows()
    out = spelling.spelling_groups(docs_of(spark, rows).repartition(3), least=5, every=every).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = plain_spelling(rows, 5, 2, 10, every)
    assert len(out) == len(want) and {tuple(x) for x in out} == want
    assert every or any(f and r != f for _, f, r, *_ in want)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(docs_of(spark, [(1, None), (None, "")])).count() == 0
    assert spelling.spelling_groups(docs_of(spark, [(1, "word word")]).limit(0)).count() == 0


def test_near_words_share_a_key():
    """For words of few bigrams, whose order is full of ties, and any edit."""
    r = random.Random(4)
    for _ in range(3000):
        letters = r.choice(["ab", "abc", "abcdefgh"])
        w = "".join(r.choices(letters, k=r.randint(4, 12)))
        k = r.randrange(len(w) + 1)
        v = r.choice([w[:k] + r.choice(letters) + w[k:], w[: max(k - 1, 0)] + r.choice(letters) + w[max(k, 1) :]])
        if v == w:
            continue
        short, long = sorted((w, v), key=len)
        grams = {x[i : i + 2] for x in (w, v) for i in range(len(x) - 1)}
        ranks = {g: n for n, g in enumerate(r.sample(sorted(grams), len(grams)))}
        keys = lambda x, longer: {key for more, key in spelling.probes(x, ranks) if more == longer}  # noqa: E731, B023
        assert keys(short, False) & keys(long, len(long) > len(short)), (w, v, ranks)


def test_words_are_cut_at_no_letter(monkeypatch):
    text = "abc déf,ghi--jklm " * 5
    for step in (1, 2, 7):
        monkeypatch.setattr(spelling, "_STEP", step)
        assert [w for p in spelling._parts(text) for w in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


# Neighbours.


def brute(rows, queries, k=5):
    """(query place, [(score, id)]) over valid rows, as the docstring says."""
    valid = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for p, (i, q) in enumerate(valid):
        if queries(i):
            scores = [(-float((q * v).sum() / (math.sqrt((q * q).sum()) * math.sqrt((v * v).sum()))), j) for o, (j, v) in enumerate(valid) if o != p and len(v) == len(q)]
            out.append((i, sorted(scores)[:k]))
    return out


def vectors(n=900, dim=24, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, dim))
    return [(i, (centres[i % 9] + r.normal(size=dim) * 0.4).astype(np.float32).tolist()) for i in range(n)]


def test_neighbours_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)  # nine ranges
    monkeypatch.setattr(neighbours, "GROUP", 30)  # and three groups
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({k: F.lit(v) for k, v in CLASHING.items()}).repartition(4)
    got = defaultdict(list)
    for x in neighbours.nearest_neighbours(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((-x.score, x.vec_id))
        assert x["rank"] == len(got[x.query_id])
    want = dict(brute(rows, lambda i: i % 10 == 0))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({j for _, j in want[q]} & {j for _, j in got[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    exact = {q: dict((j, s) for s, j in brute(rows, lambda i, q=q: i == q, 900)[0][1]) for q in list(want)[:5]}
    assert all(abs(exact[q][j] - s) < 1e-12 for q in exact for s, j in got[q]) and all(v == sorted(v) for v in got.values())


def test_neighbours_of_odd_rows(spark, monkeypatch):
    """Copies tie to smaller ids; invalid vectors take no part; lengths are apart; few candidates are all found."""
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 120)] + [(7, same), (50, same)] + [(200, [1.0, 2.0, 3.5]), (250, [-1.0, -2.0, -3.0])]
    rows += [(300, None), (350, []), (400, [0.0, 0.0, 0.0]), (450, [1.0, None, 2.0]), (500, [1.0, float("nan"), 2.0]), (550, [1.0, float("inf"), 2.0]), (None, same)]
    rows += [(600, [1.0, 0.0]), (601, [1.0, 1.0]), (602, [0.0, -1.0]), (650, [1e-200, 1e-200]), (700, [3e200, 1e200, 1e200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for x in neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank", "vec_id").collect():
        got[x.query_id].append((x.vec_id, round(x.score, 9)))
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[100]] == [0, 1, 2, 3, 4]
    assert sorted(j for j, _ in got[50]) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]  # two rows with this id, each a query
    assert [j for j, _ in got[200]] == [0, 1, 2, 3, 4] and [j for j, _ in got[250]] == [200, 0, 1, 2, 3]
    assert got[600] == [(650, round(math.sqrt(0.5), 9)), (601, round(math.sqrt(0.5), 9)), (602, 0.0)] or got[600] == [(601, round(math.sqrt(0.5), 9)), (650, round(math.sqrt(0.5), 9)), (602, 0.0)]
    assert {j for j, _ in got[650]} == {600, 601, 602} and 700 not in got
    assert not set(got) & {300, 350, 400, 450, 500, 550}
    assert neighbours.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def test_windows_find_what_they_promise():
    """Without ranges: of vectors as near as the fifth, at most MISS are overlooked, in one block and by its sorted arrays."""
    rows = vectors(2000, 32, 6)
    data = np.array([v for _, v in rows], float)
    block = neighbours.Block(np.arange(2000), np.arange(2000), data)
    hits = 0
    for q in range(0, 2000, 40):
        best = neighbours.Best(q, data[q], 5, math.inf)
        low, high = block.windows((data[q] / np.sqrt((data[q] ** 2).sum()))[None, :])
        block.search(best, low[0], high[0])
        scores = block.scores(np.arange(2000), best.query, best.length)
        scores[q] = -2
        hits += len(set(np.argsort(-scores)[:5].tolist()) & set(best.ids.tolist()))
    assert hits >= 0.98 * 250


# What earlier operators must stand.


def test_windows_with_one_hash_alike_are_two():
    """Windows that meet in the first 64 bits are told apart by the second, and keep their first occurrence each."""
    import pyarrow as pa

    from blockloom.llm import substring_dedup as sub
    from blockloom.llm.hashing import pack, pack_sorted

    def sent(chunk, hashes, ids, second):
        extra = pack(np.concatenate([np.array(ids, np.int64).view(np.uint64), np.array(second, np.uint64)]))
        return {"bucket": 1, "chunk": chunk, "step": 2, "hashes": pack_sorted(np.array(hashes, np.uint64)), "extra": extra}

    rows = [sent(0, [5, 5, 9], [1, 1, 2], [7, 8, 1]), sent(1, [5, 9, 9], [3, 4, 4], [8, 2, 3]), sent(2, [5, 9], [0, 9], [7, 1])]
    answers = {r["chunk"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8)).tolist() for r in sub._earlier(pa.Table.from_pylist(rows, schema=sub._SENT_ARROW)).to_pylist()}
    assert answers[0][:3] == [1, 0, 0] and answers[1][:3] == [1, 0, 0] and answers[2][:2] == [0, 1]


def test_texts_without_spaces_are_not_remembered(monkeypatch):
    """Words and pieces of any length are counted and encoded, and a worker holds a bounded number of bytes of them."""
    import public_tokenizers

    from blockloom.llm import token_counts as counts
    from blockloom.llm import token_files as files

    r = random.Random(6)
    texts = ["".join(r.choices("字文語編集漢", k=300)) for _ in range(40)] + ["QUJD" * 200 + str(k) for k in range(40)]
    pieces = {bytes([b]) for b in range(256)} | {b"QU", b"JD", "字".encode()}
    automaton = counts.Automaton(pieces, pieces)
    assert [automaton[t.encode()] for t in texts] == [automaton.count(t.encode()) for t in texts] and not len(automaton)
    monkeypatch.setattr(files, "REMEMBERED_BYTES", 5_000)
    encoder = files.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    plain = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for k in range(0, len(texts), 4):
        ids, n = encoder.encode([t.encode() for t in texts[k : k + 4]])
        assert ids.tolist() == [i for e in plain[k : k + 4] for i in [*e.ids, 0]] and len(n) == 4
        assert len(encoder.raw) <= 5_000 + sum(len(t.encode()) for t in texts[k : k + 4])


def test_a_tile_of_near_sets_sends_a_forest():
    """Sets that are all near to all others are as many links as sets, and join as before."""
    import pyarrow as pa

    from blockloom.llm import jaccard_join as jaccard

    r = np.random.default_rng(7)
    kinds = r.integers(0, 256, (3, jaccard.SKETCH), np.uint8)
    n = 900
    sketches = [bytes(kinds[k % 3]) for k in range(n)]
    table = lambda far: [{"id": k, "side": far, "bytes": sketches[k]} for k in range(n)]
    links = jaccard._far_against_all(0.8)(pa.Table.from_pylist(table(True) + table(False))).to_pylist()
    assert len(links) <= 2 * n
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in links:
        parent[root(e["a"])] = root(e["b"])
    assert len({root(k) for k in range(n)}) == 3 and all(root(k) == root(k % 3) for k in range(n))
