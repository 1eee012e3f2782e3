"""Vector codes, ranked search and quality rules against plain Python, on rows
with every oddity at once."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playbill.llm import cover_tree, ngram_model, quality_rules, ranked_search, vector_codes
from playbill.llm.grams import digests, windows
from tests.llm.brute import LOWER, WORD
from tests.llm.test_operators import odd_rows, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, id long, n string"


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ("en", "de", None)[k % 3], s, n, True, 0.5, 7, "n") for k, (i, t, _, s, n, *_) in enumerate(odd_rows())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


# --- vector codes ------------------------------------------------------------


@pytest.mark.parametrize("n, width, spread", [(1, 4, 3), (2, 1, 1), (60, 2, 2), (400, 4, 9), (900, 8, 300), (300, 3, 1 << 29)])
def test_cover_tree_assigns_as_all_pairs_do(n, width, spread):
    r = np.random.default_rng(n)
    x = r.integers(-spread, spread + 1, (n, width))
    tree, place = cover_tree.build(x)
    assert (tree.points[place] == x).all() and tree.counts.sum() == n
    book = r.integers(-spread, spread + 1, (min(n, 50), width))
    book[-1] = book[0]  # a tie goes to the lower entry
    d = ((x[:, None].astype(object) - book[None]) ** 2).sum(2)
    assert (tree.labels(book)[place] == [min(range(len(book)), key=lambda k: (row[k], k)) for row in d]).all()
    total, count = tree.running()
    node, entry = tree.assign(book)
    assert sum(count[tree.end[node]] - count[tree.begin[node]]) == n
    assert len(node) <= len(tree.points)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    w = len(kept[0][2]) // parts
    cut = [[tuple(v[p * w:p * w + w]) for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(col) // len(held[k]) for col in zip(*held[k], strict=True)) if k in held else e
                        for k, e in enumerate(books[p])]
    out, by_label = [], Counter()
    for (i, lab, _), c in zip(kept, cut, strict=True):
        best = [nearest(x, books[p]) for p, x in enumerate(c)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        by_label[lab] += out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, by_label[lab], sha) for i, lab, code, error in out]


@pytest.mark.parametrize("n, entries", [(0, 256), (3, 256), (400, 16)])
def test_vector_codes(spark, n, entries):
    r = random.Random(n)
    bad = [(900, None, 1), (901, [], 1), (902, [None] * 8, 1), (903, [float("nan")] + [0.0] * 7, 2), (904, [float("inf")] * 8, None)]
    good = [(i, [r.gauss(0, 0.2) for _ in range(8)], r.choice([0, 1, None])) for i in range(n)]
    if n:
        good += [good[0], (None, [0.25] * 8, 5), (950, [-0.0001] * 8, 5)] + [(1000 + k, [0.5] * 8, 3) for k in range(n)]
    data = [(*x, "clash", "x") for x in good + bad]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, code string, id string").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab, *_ in data]
    got = vector_codes.with_label_errors(*vector_codes.compress(df, entries=entries))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_codes(exact, entries=entries), key=str)


def test_vector_codes_refuse_mixed_lengths(spark):
    df = spark.createDataFrame([(1, [0.0] * 8, 1), (2, [0.0] * 12, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="components"):
        vector_codes.compress(df)[0].collect()


# --- ranked search -----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top):
    terms = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n_docs, length = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(x for _, c in terms for x in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for d, c in terms:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10 ** 9 * c[x] // (1000 * c[x] + 8 * m))
                    for x, q in asked.items() if c[x])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scores)[:top])]
    return out


def items_of(r):
    texts = [prose(k, 12) for k in range(30)] + ["", None, "no such term at all", "the THE the one", prose(50, 400), "z" * 30000 + " oak1",
                                                 "日本語の行は十文字以上です", "\x00a b\x7fc"]
    return [(k, t) for k, t in enumerate(texts)] + [(3, "elm3 elm4"), (None, "oak1 box2"), (None, prose(4, 5))]


@pytest.mark.parametrize("top, bitmaps, per_pass", [(10, 1 << 26, 2000), (3, 1, 7)])
def test_ranked_search(spark, docs, rows, monkeypatch, top, bitmaps, per_pass):
    monkeypatch.setattr(ranked_search, "BITMAPS", bitmaps)
    data = items_of(random.Random(1))
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "item_id long, text string, rank int, doc_id string")
    want = brute_search([(r[0], r[1]) for r in rows], data, top)
    got = ranked_search.search(docs, items, top=top, per_pass=per_pass)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_ranked_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "oak1")], "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_search_stops_only_when_safe():
    """Small blocks of random postings, every document against every item."""
    r = np.random.default_rng(5)
    for n_terms in (3, 70, 130):
        rows = r.random((300, n_terms)) < 0.3
        doc, term = np.nonzero(rows)
        gain = r.integers(1, 50, len(term))
        block = ranked_search.Block(np.arange(300) % 90, np.zeros(300, bool), None, np.append(0, np.cumsum(rows.sum(1))), term, gain, n_terms)
        terms, times = np.arange(n_terms), r.integers(1, 3, n_terms)
        best = ranked_search.Best(10)
        block.search(terms, times, best)
        dense = np.zeros((300, n_terms), np.int64)
        dense[doc, term] = gain
        want = sorted((-s, d) for s, d in zip((dense @ times).tolist(), (np.arange(300) % 90).tolist(), strict=True) if s > 0)[:10]
        assert [(-s, d) for s, d in zip(best.score.tolist(), best.doc.tolist(), strict=True)] == want


# --- quality rules -----------------------------------------------------------


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    held = defaultdict(list)
    for i in range(len(words) - 7):
        held[tuple(words[i:i + 8])].append(i)
    again = {j for at in held.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    dup = len(lines) - len(set(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again),
            len(words) < 20 or 100 * len(again) > 30 * len(words))


def brute_model(texts, order=5):
    """log P of every byte, by the textbook recursion."""
    grams = Counter()
    for t in texts:
        b = bytes(order - 1) + (t or "").encode()
        grams.update(b[i:i + order] for i in range(len(b) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off = {k: ngram_model.discounts(Counter(c for c in v.values() if c <= 4)) for k, v in counts.items()}
    below = {k: defaultdict(list) for k in counts}
    for k, v in counts.items():
        for g, c in v.items():
            below[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / 256
        k, seen = len(g), below[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        c = counts[k].get(g, 0)
        take = lambda x: off[k][min(x, 3) - 1]
        return (max(c - take(c), 0) if c else 0) / sum(seen) + sum(map(take, seen)) / sum(seen) * p(g[1:])

    def log(text):
        b = bytes(order - 1) + (text or "").encode()
        return sum(math.log(p(b[i:i + order])) for i in range(len(b) - order + 1))
    return log


def test_base_rules(rows):
    texts = [r[1] for r in rows] + [prose(7, 50) + " " + prose(7, 50), "a\nb\na \n\na\nA", "x " * 7, "x " * 8, "x " * 9, "a|b <c> #\xa0#"]
    got = quality_rules.base_counts(pa.array(texts)).to_pylist()
    assert [tuple(g.values()) for g in got] == [brute_base(t)[:5] for t in texts]


@pytest.mark.parametrize("shard", [ngram_model.SHARD, 2000])
def test_quality_rules(spark, docs, rows, shard):
    """The whole verdict, with one shard of the model and with many."""
    log = brute_model([r[1] for r in rows])
    full, steps = quality_rules.FULL, quality_rules.STEPS
    scored = []
    for i, t, lang, *_ in rows:
        n = len((t or "").encode())
        scored.append((i, lang, *brute_base(t), n, -log(t) / n if n else None))
    by, gaps = defaultdict(list), defaultdict(list)
    fit = [(r[1], math.floor(r[9] * steps), r[8]) for r in scored if not r[7] and r[8]]
    for lang, s, _ in fit:
        by[lang].append(s)
    low = lambda v: sorted(v)[(len(v) - 1) // 2]
    middle = {k: low(v) for k, v in by.items()}
    off = lambda s, n, lang: math.floor((s - middle[lang]) * math.sqrt(min(n, full) / full))
    for lang, s, n in fit:
        gaps[lang].append(abs(off(s, n, lang)))
    every = max(low([g for v in gaps.values() for g in v]), quality_rules.LEAST_SPREAD)
    spread = {k: max((len(v) * low(v) + quality_rules.PRIOR * every) / (len(v) + quality_rules.PRIOR), quality_rules.LEAST_SPREAD)
              for k, v in gaps.items()}
    want = []
    for i, lang, *base, failed, n, nats in scored:
        kept = not failed and n > 0 and -quality_rules.LOWER * spread[lang] <= off(math.floor(nats * steps), n, lang) <= quality_rules.UPPER * spread[lang]
        want.append((i, *base, failed, kept, round(math.exp(nats), 3) if n else None))
    got = quality_rules.rules(docs, shard=shard).collect()
    assert got[0].__fields__[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    found = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"],
              None if r["perplexity"] is None else round(r["perplexity"], 3)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_probabilities_add_up(spark):
    docs = spark.createDataFrame([("abracadabra " * 5,), ("été",), (None,)], "text string")
    model = ngram_model.entries(ngram_model.gram_counts(docs))
    shard, = ngram_model.shards(model)
    for context in (b"abra", b"zzzz", b"\0\0\0\0"):
        head = int.from_bytes(context, "big") << 8
        assert abs(np.exp(shard.log_probability(head + np.arange(256))).sum() - 1) < 1e-5


def test_the_model_grows_with_the_corpus(spark):
    sizes = [ngram_model.gram_counts(spark.createDataFrame([(prose(k, 400),) for k in range(n)], "text string")).agg(F.sum("c")).first()[0]
             for n in (5, 25)]
    assert sizes[1] > 4.9 * sizes[0]


def test_rules_of_nothing(spark, docs):
    assert quality_rules.rules(docs.limit(0)).count() == 0
    none = quality_rules.rules(docs.withColumn("text", F.lit(None).cast("string"))).select("kept", "base_failed").distinct().collect()
    assert [tuple(r) for r in none] == [(False, True)]


def test_gibberish_is_rejected_and_prose_kept(spark):
    r = random.Random(3)
    good = [(k, " ".join(r.choice(["the", "river", "runs", "over", "stones", "and", "under", "bridges", "towards", "open", "water"]) for _ in range(150)))
            for k in range(120)]
    noise = [(1000 + k, " ".join("".join(r.choice("qxzkvjw#%&") for _ in range(6)) for _ in range(150))) for k in range(4)]
    got = quality_rules.rules(spark.createDataFrame([(i, t, "en") for i, t in good + noise], "doc_id long, text string, lang string"))
    kept = {x["doc_id"] for x in got.filter("kept").collect()}
    assert not kept & {i for i, _ in noise} and len(kept) >= 115


# --- hashes ------------------------------------------------------------------


def test_windows_and_digests_tell_apart_what_sums_of_powers_do_not():
    twin = np.array([bin(k).count("1") % 2 for k in range(4096)], np.uint64)
    for lane in (0, 1):
        assert windows(twin, 4096, lane) != windows(1 - twin, 4096, lane)
        h = windows(twin[:600], 50, lane)
        assert len(set(h.tolist())) == len({twin[i:i + 50].tobytes() for i in range(551)})
    both = np.concatenate([twin, 1 - twin]).astype(np.uint8)
    a, b = digests(both, np.array([0, 4096]), np.array([4096, 8192]))
    assert (a != b).all()
