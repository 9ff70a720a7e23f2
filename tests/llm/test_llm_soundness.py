"""What the corpus operators must stand: texts made to collide, repeated ids, hot keys, filters beyond their limits, crowded nodes, and trees and flows against brute force."""

import collections
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from blockloom.llm import html_extract as html
from blockloom.llm import mixing
from blockloom.llm.common import looked_up
from blockloom.llm.components import components
from blockloom.llm.exact_dedup import drop_exact_copies, exact_dedup, without
from blockloom.llm.hashing import hashed_words, rolled
from blockloom.llm.jaccard_join import MAX_DEPTH, jaccard_classes, one_of_each_class, runs_for
from blockloom.llm.substring_dedup import substring_dedup
from blockloom.llm.token_files import Encoder, write_token_files


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], "doc_id long, text string, lang string, source string")


def opposites(n, a, b):
    """The Thue-Morse sequence of n letters, and the one with its letters exchanged: sums of powers modulo 2**64 can't tell them apart."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return [a if x else b for x in bits], [b if x else a for x in bits]


# Texts made to collide.


def test_words_made_to_collide(spark):
    x, y = ("".join(w) for w in opposites(1024, "a", "b"))
    tail = " ".join(f"w{k}" for k in range(19))
    got = {r.doc_id: r.n_removed for r in substring_dedup(docs_of(spark, [(1, f"{x} {tail}"), (2, f"{y} {tail}")])).collect()}
    assert got == {1: 0, 2: 0}
    assert {r.n_links for r in jaccard_classes(docs_of(spark, [(1, x), (2, y)])).collect()} == {0}


def test_texts_made_to_collide(spark):
    x, y = (" ".join(w) for w in opposites(2048, "left", "right"))
    words = [hashed_words(t.encode()) for t in (x, y)]
    for size in (5, 8, 20, 1024):
        ours, theirs = (rolled(w, size) for w in words)
        spans = [{tuple(t.split()[k : k + size]) for k in range(2048 - size + 1)} for t in (x, y)]
        assert len(set(ours.tolist())) == len(spans[0]) and len(set(ours.tolist()) | set(theirs.tolist())) == len(spans[0] | spans[1])
    got = jaccard_classes(docs_of(spark, [(1, x + " z"), (2, y + " q")])).collect()
    assert len(got) == 2  # the same shingles but for the ends: linked, and not taken for one text
    assert {r.class_id for r in got} == {1} and {r.n_links for r in got} == {1}


def test_pieces_made_to_collide(tmp_path):
    from blockloom.llm.queries import vocabulary

    with open(vocabulary(), encoding="utf-8") as f:
        e = Encoder(f.read())
    x, y = ("".join(w) for w in opposites(2048, "a", "b"))
    ids, n = e.encode([x.encode(), y.encode()])
    assert ids[: n[0]].tolist() != ids[n[0] :].tolist()
    assert ids[: n[0] - 1].tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids and ids[n[0] : -1].tolist() == e.tokenizer.encode(y, add_special_tokens=False).ids


def test_a_word_longer_than_a_part():
    import blockloom.llm.hashing as h

    text = b" ".join([b"x" * k for k in (1, 5, 3_000_000, 2)] + [b"y"] * 900_000)
    assert len(hashed_words(text)) == 900_004
    assert (hashed_words(text)[:4] == [h.xxhash.xxh3_64_intdigest(b"x" * k) for k in (1, 5, 3_000_000, 2)]).all()


# Repeated, null and other ids.


def words_of(k, n):
    r = random.Random(k)
    return " ".join(f"v{r.randrange(10**9)}" for _ in range(n))


def test_rows_that_repeat_an_id_stay_apart(spark):
    a, b = words_of(1, 60), words_of(2, 60)
    df = docs_of(spark, [(3, a), (5, a + " tail"), (5, b), (None, a + " more"), (None, words_of(3, 40)), (7, b), (7, b), (8, None), (8, None), (9, " ")])
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(df).collect())
    assert got == collections.Counter({(3, None, 2): 1, (5, None, 2): 1, (5, 5, 2): 1, (None, None, 2): 1, (None, None, 0): 1, (7, 5, 2): 2, (8, 8, 0): 2, (9, 9, 0): 1})
    left = collections.Counter((r.doc_id, r.text) for r in one_of_each_class(df).collect())
    assert left == collections.Counter({(None, a + " more"): 1, (None, words_of(3, 40)): 1, (5, b): 1, (8, None): 2, (9, " "): 1})
    only = one_of_each_class(docs_of(spark, [(3, a), (5, a + " tail"), (5, b)])).collect()
    assert {(r.doc_id, r.text) for r in only} == {(3, a), (5, b)}
    twice = one_of_each_class(docs_of(spark, [(3, a), (3, a), (4, a)])).collect()
    assert [(r.doc_id, r.text) for r in twice] == [(3, a)]


def test_ids_must_be_whole_numbers(spark):
    df = spark.createDataFrame([("x", "a b c")], "doc_id string, text string")
    for call in (substring_dedup, jaccard_classes, one_of_each_class, lambda d: write_token_files(d, "/nowhere")):
        with pytest.raises(ValueError, match="whole number"):
            call(df)


# Hot keys, filters and joins beyond their limits.


def test_a_hot_key_is_looked_up(spark):
    rows = [(1, k) for k in range(900)] + [(2, k) for k in range(5)] + [(None, 0), (3, 1)]
    df = spark.createDataFrame(rows, "key long, k long").repartition(5)
    values = spark.createDataFrame([(1, "hot"), (2, "cold"), (9, "none")], "key long, v string")
    got = looked_up(df, "key", values)
    assert got.columns == ["key", "k", "v"]
    assert collections.Counter((r.key, r.v) for r in got.collect()) == {(1, "hot"): 900, (2, "cold"): 5, (None, None): 1, (3, None): 1}
    missing = looked_up(df, "key", values.where("key <> 1"))
    assert collections.Counter((r.key, r.v) for r in missing.collect()) == {(1, None): 900, (2, "cold"): 5, (None, None): 1, (3, None): 1}


def test_components_of_stars_chains_and_cycles(spark):
    links = [(10, k) for k in range(100, 1700)] + [(k, k + 1) for k in range(5000, 5130)] + [(7000, 7001), (7001, 7002), (7002, 7000), (9, 9), (5130, 7002)]
    random.Random(1).shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{10: 10}, **{k: 10 for k in range(100, 1700)}, **{k: 5000 for k in [*range(5000, 5131), 7000, 7001, 7002]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_that_stay_are_not_shuffled(spark):
    df = docs_of(spark, [(k, f"text {k % 70}") for k in range(100)])
    out = drop_exact_copies(df)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 70 and {r.doc_id for r in out.collect()} == {*range(30, 100)}


@pytest.mark.parametrize(("broadcast_rows", "max_filter_bytes"), [(1000, 1 << 20), (0, 1 << 20), (0, 0)])
def test_decisions_on_rows(spark, broadcast_rows, max_filter_bytes):
    rows = [(k, f"t{k % 40}") for k in range(80)] + [(None, "n"), (None, None), (5, "t5"), (5, "t5"), (6, "other")]
    df = docs_of(spark, rows).withColumns({"key": F.lit(1), "one": F.lit(True), "row": F.lit("r"), "h": F.lit(2), "sha": F.lit("s")})
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    decided = df.where("doc_id < 10 OR doc_id IS NULL").groupBy(F.col("doc_id").alias("id"), digest.alias("sha")).agg(F.expr("max(doc_id) = 5").alias("one")).withColumn("one", F.coalesce("one", F.lit(False)))
    out = without(df, decided, "doc_id", "text", broadcast_rows, max_filter_bytes)
    assert out.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter([(k, t) for k, t in rows[:80] if k >= 10] + [(5, "t5")])


def test_exact_dedup_beyond_the_filter(spark):
    rows = [(k, f"t{k % 30}") for k in range(100)] + [(7, "t7"), (None, "t1"), (None, "alone")]
    want = collections.Counter(map(tuple, exact_dedup(docs_of(spark, rows)).collect()))
    assert collections.Counter(map(tuple, exact_dedup(docs_of(spark, rows), max_filter_bytes=0).collect())) == want and sum(want.values()) == 103
    assert sorted(map(str, drop_exact_copies(docs_of(spark, rows), max_filter_bytes=0).collect())) == sorted(map(str, drop_exact_copies(docs_of(spark, rows)).collect()))


# Recall in crowded nodes.


@pytest.mark.parametrize("node_limit", [4096, 40])
def test_recall_where_all_are_rather_similar(spark, node_limit):
    """A third of every text is the same in all, so nodes are crowded; pairs at three similarities are planted in them."""
    r = random.Random(3)
    shared = [f"s{k}" for k in range(150)]
    rows, pairs = [], collections.defaultdict(list)
    for k in range(240):
        own = [f"o{k}x{j}" for j in range(250)]
        rows.append((2 * k, " ".join(shared + own)))
        for level, changed in ((0.80, 8), (0.85, 6), (0.90, 4)):
            if k % 3 == int(level * 20) - 16:
                other = [*own]
                for at in range(changed):
                    other[10 + at * 28 + r.randrange(8)] = f"c{k}x{at}"
                rows.append((2 * k + 1, " ".join(shared + other)))
                pairs[level].append((2 * k, 2 * k + 1))
    grams = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    got = {x.doc_id: x.class_id for x in jaccard_classes(docs_of(spark, rows), node_limit=node_limit).collect()}
    for level, planted in pairs.items():
        near = [(a, b) for a, b in planted if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
        found = sum(got[b] == a for a, b in near) / len(near)
        print(f"node_limit {node_limit}, planted at {level}: {len(near)} pairs of at least 0.8, found {found:.3f}")
        assert len(near) >= 60 and found >= 0.97
    assert sum(i != c for i, c in got.items()) <= sum(map(len, pairs.values()))


def test_runs_hold_at_any_depth():
    survive = 1.0
    for level in range(MAX_DEPTH):
        survive = 1 - math.exp(-survive * (2 if level < MAX_DEPTH - 1 else 1))
    assert 1 - (1 - survive) ** runs_for(0.99, 0.8) >= 0.99


# Texts over a chunk, and many chunks.


@pytest.fixture(scope="module")
def long_rows():
    """13 MB in one partition: chunks of 4 MB, a text over a chunk, and passages that they share."""
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    base = [word() for _ in range(100_000)]
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(base[:90_000]), " ".join([*base[:90_000], "end"])]
    for k in range(9):
        texts.append(" ".join(word() for _ in range(70_000)) + f" {passage} " + " ".join(word() for _ in range(60_000)) * (1 + 4 * (k == 4)))
    return list(enumerate(texts))


def test_repeats_across_chunks(spark, long_rows):
    df = docs_of(spark, long_rows).coalesce(1)
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup(df).select("doc_id", "n_words", "n_removed").collect()}
    seen, want = set(), {}
    for i, text in long_rows:
        words = text.split()
        gone = bytearray(len(words))
        for k in range(len(words) - 19):
            window = " ".join(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = b"\1" * 20
            else:
                seen.add(window)
        want[i] = (len(words), sum(gone))
    assert got == want and want[1][1] == 90_000 and all(want[k][1] >= 60 for k in range(3, 11))


def test_links_and_equal_texts_across_chunks(spark, long_rows):
    rows = [*long_rows, (50, long_rows[6][1] + " tail"), (51, long_rows[6][1])]
    df = docs_of(spark, rows).coalesce(1)
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard_classes(df).collect()}
    assert got == {i: (i, 0) for i, _ in long_rows} | {0: (0, 1), 1: (0, 1), 6: (6, 2), 50: (6, 2), 51: (6, 2)}
    kept = exact_dedup(df).where("kept").select("doc_id").collect()
    assert {x.doc_id for x in kept} == {i for i, _ in rows} - {6}


def test_a_very_long_page_and_turn(spark, long_rows):
    from blockloom.llm import chat_format as chat

    text = long_rows[6][1]
    page = spark.createDataFrame([(1, "http://x.com/1", f"<nav>m</nav><p>{text}</p>")], "page_id long, url string, html string")
    assert html.extract_main_text(page).first()["text"] == text
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text + "</s>")], "conv_id long, turn long, role string, text string")
    read = chat.chat_read(chat.chat_format(turns)).first()
    assert read.loss_text == text + "</s>" and [t.text for t in read.turns] == [text, text + "</s>"]


# The flow against all flows.


def cheapest(words, quotas, costs):
    """The most words that any flow moves, and the least it costs, over all whole flows."""
    arcs = [(p, s) for p in words for s in p]
    best = (0, 0)
    for amounts in itertools.product(*(range(min(quotas[s], len(costs) * words[p]) + 1) for p, s in arcs)):
        of, at = collections.Counter(), collections.Counter()
        for (p, s), n in zip(arcs, amounts):
            of[p] += n
            at[s] += n
        if all(at[s] <= quotas[s] for s in at) and all(of[p] <= len(costs) * words[p] for p in of):
            price = sum(sum(costs[k] * max(0, min(words[p], of[p] - k * words[p])) for k in range(len(costs))) for p in of)
            best = min(best, (-sum(amounts), price))
    return -best[0], best[1]


@pytest.mark.parametrize("seed", range(12))
def test_flow_against_all_flows(seed):
    r = random.Random(seed)
    kinds = [("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c"), ("c",)]
    words = {p: r.randint(1, 3) for p in r.sample(kinds, r.randint(1, 3))}
    quotas = {s: r.randint(0, 4) for s in "abc"}
    flow = mixing.min_cost_flow(words, quotas)
    of, at = collections.Counter(), collections.Counter()
    for (p, s), n in flow.items():
        assert s in p and n > 0
        of[p] += n
        at[s] += n
    assert all(at[s] <= quotas[s] for s in at) and all(of[p] <= 3 * words[p] for p in of)
    price = sum(sum(c * max(0, min(words[p], of[p] - k * words[p])) for k, c in enumerate(mixing.COPY_COST)) for p in of)
    assert (sum(flow.values()), price) == cheapest(words, quotas, mixing.COPY_COST)


def plain_mix(rows, seed_hash, weights):
    """How many words of each id the mix takes: by one walk over each source's documents in the order of their hashes."""
    sizes = collections.defaultdict(lambda: collections.Counter())
    for i, text, _, source in rows:
        sizes[source][i] += len((text or "").split())
    words = {s: sum(c.values()) for s, c in sizes.items()}
    goal = mixing.targets(words, weights, sum(words.values()))
    out = {}
    for s, c in sizes.items():
        much = min(round(goal[s]), 3 * words[s])
        times, gap = divmod(much, words[s]) if words[s] else (0, 0)
        order = sorted((i for i in c if c[i]), key=lambda i: (seed_hash[i], str(i)))
        more = set()
        for i in order:
            if gap and c[i] <= gap:
                more.add(i)
                gap -= c[i]
        left = [(c[i], seed_hash[i], str(i), i) for i in order if i not in more and c[i] < 2 * gap]
        if left:
            more.add(min(left)[3])
        out |= {(s, i): (times + (i in more)) for i in c}
    return out, goal


@pytest.mark.parametrize("seed", [0, 5])
def test_mix_against_a_plain_walk(spark, seed):
    import corpus_pipeline as p

    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(int(r.paretovariate(0.7)) % 3000)) or None, None, r.choice(["a", "b", "b", "b", "c", None])) for i in range(500)] + [(600, "x y", None, "d")]
    df = docs_of(spark, rows)
    hashes = {x[0]: x[1] for x in df.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))).collect()}
    weights = mixing.cycled_weights(list({x[3] for x in rows}))
    want, goal = plain_mix(rows, hashes, weights)
    got = mixing.mix_sources(df, seed=seed, keep=["doc_id", "source"]).collect()
    assert {(x.source, x.doc_id): x.taken // x.size if x.size else 0 for x in got} == {k: n if (dict((i, t) for i, t, *_ in rows)[k[1]]) else 0 for k, n in want.items()}
    assert all(x.target == goal[x.source] for x in got)
    if seed == 0:
        stage = collections.Counter(x.doc_id for x in p.mixture(spark, df, "").collect())
        assert stage == collections.Counter({x.doc_id: x.taken // x.size for x in got if x.taken})


# The site style tree against a plain recursion.


class Filled:
    """A style node of a page with its content."""

    def __init__(self, style):
        self.above, self.declared, self.shows = style.above, style.declared, style.shows
        self.features, self.places, self.chars = collections.Counter(style.links), set(), 0


def plain_tree(pages):
    """What is low of each site of (site, page): style nodes and texts; and the importance of nodes."""
    sites = collections.defaultdict(dict)
    for site, page in pages:
        blocks, styles = html.parsed(page, site)
        styles = {n: Filled(x) for n, x in styles.items()}
        for b in blocks:
            styles[b.node].features.update(b.all.split())
            styles[b.node].places.add(b.place())
            styles[b.node].chars += len(b.all)
        sites[site].setdefault("\n".join(b.text for b in blocks if not b.noise and b.text), styles)
    low, weights = {}, {}
    for site, different in sites.items():
        seen = collections.defaultdict(list)
        for styles in different.values():
            full = {w for x in styles.values() if x.features for w in x.above}
            for w in full:
                seen[w].append(styles[w])
        kids = collections.defaultdict(set)
        for w, xs in seen.items():
            if len(xs[0].above) > 1:
                kids[xs[0].above[1]].add(w)
        own, importance = {}, {}
        for w, xs in seen.items():
            uses = collections.defaultdict(list)
            for x in xs:
                for f, n in x.features.items():
                    uses[f].append(n)
            entropy = [-sum(n / sum(v) * math.log(n / sum(v)) for n in v) for v in uses.values()]
            if uses:
                own[w] = 1.0 if len(xs) < 2 else 1 - sum(entropy) / len(entropy) / math.log(len(xs))

        def weigh(w, seen=seen, kids=kids, own=own, importance=importance):
            shows = collections.Counter(s for x in seen[w] for s in x.shows)
            total = sum(shows.values())
            shown = 1.0 if total < 2 else -sum(n / total * math.log(n / total) for n in shows.values()) / math.log(total)
            weight = html.GAMMA ** max(0, sum(s != 0 for s in shows) - 1)
            content = sum(bool(x.features) for x in seen[w])
            parts = content + sum(len(seen[k]) for k in kids[w])
            inner = content * own.get(w, 0) + sum(len(seen[k]) * weigh(k) for k in kids[w])
            importance[w] = min(1.0, (1 - weight) * shown + weight * inner / max(parts, 1))
            return importance[w]

        if not seen:
            continue
        weigh(html._digest(site))
        chars = {w: sum(x.chars for x in xs) for w, xs in seen.items()}
        main = max(((chars[w] * i, i) for w, i in own.items() if not seen[w][0].declared & html.NOISE_NODE), default=(0, 1.0))[1]
        proof = lambda m: 1 - m**-html.EVIDENCE
        branch = set()
        for w, xs in seen.items():
            limit = 0.95 if xs[0].declared & html.ARTICLE_NODE else min(max(html.FLOOR, html.RATIO * (1 - main)), 0.95)
            if not xs[0].declared & html.PAGE_NODE and proof(len(xs)) * (1 - importance[w]) > limit:
                branch.add(w)
        gone = {w for w, xs in seen.items() if branch & set(xs[0].above)}
        for xs in seen.values():
            for t, n in collections.Counter(t for x in xs for t in x.places).items():
                if len(xs) > 1 and proof(len(xs)) * math.log(n) / math.log(len(xs)) > 0.95:
                    gone.add(t)
        low[site], weights[site] = gone, importance
    return low, weights


def plain_text(page, site, low):
    blocks = [b for b in html.parsed(page, site)[0] if not b.noise and b.text and b.node not in low and b.place() not in low]
    article = [b.text for b in blocks if b.article]
    return " ".join(article if 2 * sum(map(len, article)) > sum(len(b.text) for b in blocks) else [b.text for b in blocks])


def templated(seed, site, n, articles=False):
    """Pages of one template without telling names: a bar of links, a body of paragraphs, cards, a bottom; some parts are not on all pages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("aeiorstnlmd", k=r.randint(2, 9)))
    links = [word() for _ in range(7)]
    main = "article" if articles else "div class=z9"
    out = []
    for k in range(n):
        bar = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in links) + (f"<li><a href='/{k}'>now {k}</a></li>" if r.random() < 0.5 else "")
        story = "".join(f"<p>{' '.join(word() for _ in range(r.randint(8, 60)))}</p>" + ("<hr>" if r.random() < 0.1 else "") for _ in range(r.randint(1, 6)))
        card = f"<div class=k7><h3>You may like</h3><p>{r.choice(links)} and {r.choice(links)}</p></div>" if r.random() < 0.7 else ""
        out.append((site, f"<html><body><div class=a1><ul>{bar}</ul></div><{main}><h1>{' '.join(word() for _ in range(5))}</h1>{story}</{main.split()[0]}>{card}<div class=q2><span>All of it is ours, whatever {2000 + k % 5}</span><p>Write to us</p></div>", story))
    return out


def test_site_tree_against_a_plain_one(spark):
    pages = [*templated(1, "a.com", 60), *templated(2, "b.org", 25, articles=True), *templated(3, "c.net", 3), *templated(4, "", 1), *templated(1, "a.com", 60)[:5]]
    pages += [("d.com", "<p>same</p>", "")] * 30 + [("e.com", f"<div><p>head</p><p>x{k}</p></div>", "") for k in range(30)] + [("f.com", None, ""), ("f.com", "", "")]
    df = spark.createDataFrame([(k, f"http://{s}/{k}" if s else None, p) for k, (s, p, _) in enumerate(pages)], "page_id long, url string, html string").repartition(7)
    low, weights = plain_tree([(s, p or "") for s, p, _ in pages])
    got = {r.page_id: r.text for r in html.extract_main_text(df).collect()}
    assert got == {k: plain_text(p or "", s, low.get(s, set())) for k, (s, p, _) in enumerate(pages)}
    # The tree alone finds the story: nothing is declared on a.com.
    for k, (s, _, story) in enumerate(pages):
        if s == "a.com":
            assert re.sub("<[^>]*>", " ", story).split() == got[k].split()[-len(re.sub("<[^>]*>", " ", story).split()) :]
            assert "Write to us" not in got[k] and "You may like" not in got[k] and "now" not in got[k].split()
    assert all(got[k] == "x" + str(k - 124) or "head" not in got[k] for k, (s, *_) in enumerate(pages) if s == "e.com")


def test_importance_of_every_branch(spark):
    pages = [*templated(5, "a.com", 40), *templated(6, "b.org", 12, articles=True), *templated(7, "c.net", 1)]
    _, weights = plain_tree([(s, p) for s, p, _ in pages])
    pages += pages[:3] + pages[1:2]  # copies
    rows = spark.createDataFrame([(s, p) for s, p, _ in pages], "host string, html string").repartition(5)
    counts = html.site_counts(rows.mapInArrow(html._parse(0), html._PAGES).cache(), 4)
    got = {r.node: r.importance for r in html.importance(counts).collect()}
    want = {w: i for of in weights.values() for w, i in of.items()}
    assert got.keys() == want.keys()
    assert all(got[w] == pytest.approx(want[w], abs=1e-4) for w in want)


# The pipeline's stages on edge cases.


def test_stages_on_edge_cases(spark):
    import corpus_pipeline as p

    long = words_of(9, 30_000)
    rows = [(1, None, None, None), (None, None, "en", "s"), (2, "", "en", "s"), (3, long, "en", "s"), (4, words_of(4, 80), None, "s"), (4, words_of(4, 80), None, "s"), (None, words_of(5, 50), "de", None), (6, words_of(4, 80) + " end", "en", "s"), (7, words_of(7, 60), "en", "t"), (7, words_of(8, 60), "en", "t")]
    docs = docs_of(spark, rows).withColumns({"size": F.lit("x"), "kept": F.lit(1), "row": F.lit(2), "key": F.lit(3), "hi": F.lit(4), "taken": F.lit("y"), "n_words": F.lit(5)})
    for df, least in ((docs, 1), (docs.limit(0), 0)):
        left = df
        for k, (_, stage) in enumerate(p.STAGES):
            left = stage(spark, left, "")
            assert k == 4 or left.dtypes == df.dtypes
        assert (left.count() > 0) == bool(least)
    alone = [{(r.doc_id, r.text) for r in stage(spark, docs_of(spark, rows), "").collect()} for _, stage in p.STAGES[:4]]
    texts = {(i, t) for i, t, *_ in rows}
    assert alone[0] == {(i, t) for i, t in texts if t}
    assert alone[1] == (texts - {(1, None), (None, None)}) and alone[2] == texts - {(6, words_of(4, 80) + " end")}
    assert alone[3] <= {(i, t) for i, t in texts if t} and alone[3]
