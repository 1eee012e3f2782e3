"""Operators against plain Python, on rows with every oddity at once."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playbill.llm import (embedding_dedup, exact_dedup, jaccard, line_dedup, mixing, quality, sequences,
                          substring_dedup, suffix_dedup, tokenfiles)
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, score double, id long, n string"
LAST = (1 << 63) - 1


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["oak", "elm", "Ash", "été", "fir.", "yew", "bay", "box", "sloe", "plum"]) + str(r.randint(0, 40))
                    for _ in range(n))


def odd_rows():
    a, b = prose(1, 300), prose(2, 120)
    passage = prose(3, 90)
    texts = [
        (1, a, "s1"), (2, a.replace("oak", "oak", 1), "s2"), (3, a[:-3] + "end", "s1"), (4, b, None), (5, None, "s1"),
        (6, "", "s2"), (7, " \n\t ", None), (8, "one two", "s3"), (9, "ONE two", "s3"), (10, "x\n" + passage + "\ny " + prose(9, 20), "s1"),
        (11, prose(10, 30) + "\n" + passage + "\n" + prose(11, 60), "s2"), (12, prose(12, 9000) + " " + "z" * 30000, "s1"),
        (13, "the the " * 200, "s1"), (14, "aa bb cc dd", "s4"), (14, "aa bb cc ee\n\nline of some length here", "s4"),
        (15, b, "s1"), (15, b, "s1"), (None, a, "s1"), (None, "no id\nline of some length here", None), (16, "ß é\xa0x\x1cy <|endoftext|>", "s2"),
        (17, "Line Of Some Length Here  \n日本語の行は十文字以上です\nx", "s1"), (18, "日本語の行は十文字以上です", "s1"),
        (-5, "negative id " + passage, "s2"), (19, "q" * 1500, "s1"), (20, b + "\n" + b, "s5")]
    texts += [(100 + k, a[:1500] + f" copy {k}", "s1") for k in range(25)]
    return [(i, t, "en", s, 0, "clash", 0.5, 7, "n") for i, t, s in texts]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], brute.sha(t or "")) for i, t, *_ in rows), key=str)
    got = exact_dedup.mark_duplicates(docs, block_bytes=16).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == want
    kept = exact_dedup.drop_duplicates(docs, block_bytes=64)
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1] or "") for r in kept.collect()), key=str) == sorted(((i, t) for t, i in best.items()), key=str)
    assert exact_dedup.mark_duplicates(none).count() == 0


def test_jaccard(docs, rows, none):
    for width, percent in ((4, 85), (2, 60)):
        got = sorted(map(tuple, jaccard.near_groups(docs, width, percent).collect()), key=str)
        assert got == brute.near_groups([(r[0], r[1]) for r in rows], width, percent)
    assert jaccard.near_groups(none).count() == 0


def test_jaccard_with_frequent_tokens(spark, monkeypatch):
    """Chains of near copies whose tokens are all frequent: pairs of tokens."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    r, rows = random.Random(5), []
    for base in range(6):
        words = prose(base, r.choice([12, 40, 150])).split()
        for k in range(14):
            words = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 30))):
                words[r.randrange(len(words))] = f"w{r.randint(0, 99)}"
            rows.append((base * 100 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_groups(docs, 3, 80).collect()), key=str)
    assert got == brute.near_groups(rows, 3, 80)


def test_jaccard_in_a_group_of_near_copies_below_the_threshold(spark, monkeypatch):
    """Copies of one text, each with words of its own, so that few pairs are
    similar: all share passages, and ids with several texts are among them."""
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    r, base, rows = random.Random(8), prose(1, 160).split(), []
    for k in range(70):
        words = list(base)
        for j in range(r.choice([1, 2, 4, 6, 8])):
            words[r.randrange(len(words))] = f"own{k}x{j}"
        rows.append((r.choice([k, k, 7]), " ".join(words[:r.choice([160, 160, 150, 60])])))
    calls, plain = [], jaccard.delta_links
    monkeypatch.setattr(jaccard, "delta_links", lambda m, p: calls.append(plain(m, p)) or calls[-1])
    got = sorted(map(tuple, jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()), key=str)
    assert got == brute.near_groups(rows, 3, 85)
    assert sum(c.count() for c in calls) > 0  # some links only deltas show


def test_line_dedup(docs, rows, none):
    def key(line):
        return line.strip(" \t\n\r\x0b\x0c").translate(brute.LOWER)

    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(LAST if i is None else i)
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == (LAST if i is None else i)]
        want.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    for bits in (line_dedup.MAX_BITS, 1 << 16):
        got = line_dedup.dedup_lines(docs, 10, bits).select("doc_id", "n_lines", "n_dropped", "kept_text")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert line_dedup.dedup_lines(none).count() == 0


def test_substring_dedup(docs, rows, none):
    want = brute.windows([(LAST if r[0] is None else r[0], r[1]) for r in rows], 50)
    got = substring_dedup.dedup_words(docs).select(
        F.coalesce("doc_id", F.lit(LAST)), "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(tuple, got.collect())) == want
    assert substring_dedup.dedup_words(none).count() == 0


@pytest.mark.parametrize("many", [20_000, 2])
def test_suffix_dedup(docs, rows, none, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    want = brute.substrings([(LAST if r[0] is None else r[0], r[1]) for r in rows], 400)
    got = suffix_dedup.dedup_bytes(docs).select(F.coalesce("doc_id", F.lit(LAST)), "n_bytes", "n_removed",
                                                F.size("spans"), F.sha2("kept_bytes", 256))
    assert sorted(map(tuple, got.collect())) == want
    assert suffix_dedup.dedup_bytes(none).count() == 0


def test_mixing(docs, rows, none):
    got = mixing.mix(docs, weights=(5, 2, 1)).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(brute.WORD.findall(t or ""))
    target = {s: 0.0 for s in size}
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free, left = set(order), float(sum(size.values()))
    while free:  # share, stop at the caps, share the rest again
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if per * weight[s] > 3 * size[s]}
        for s in over or free:
            target[s] = 3.0 * size[s] if over else per * weight[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    sums, seen = Counter(), {}
    for r in got:
        seen[r["source_size"]] = r["target"]
        sums[r["target"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s in order:
        assert seen[size[s]] == pytest.approx(target[s])
    for t, taken in sums.items():
        assert taken == int(t + 0.5)
    again = mixing.mix(docs.repartition(3), weights=(5, 2, 1)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(r["taken"] for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_packing(docs, rows, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = sequences.packed_pieces(docs, path, capacity=256).collect()
    want, total = [], 0
    for i, t, *_ in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for p, (start, n) in enumerate(sequences.cut(len(ids), 256)):
            want.append((i, p, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for seq in places.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= 1.05 * -(-total // 256) + 1
    made = sequences.sequences(docs, path, capacity=256).collect()
    assert sum(len(r["ids"]) for r in made) == total and len(made) == len(places)
    assert sequences.packed_pieces(none, path).count() == 0


def test_token_files(spark, docs, rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    folder = tokenfiles.token_folder(spark)
    tokenfiles.write_tokens(docs, path, "words", 2, folder, block=64, segment_ids=500)
    got = tokenfiles.read_tokens(spark, folder, with_ids=True).collect()
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(model.encode(t or "", add_special_tokens=False).ids + [2])
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(i), x) for i, xs in ids.items() for x in xs)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    empty = tokenfiles.token_folder(spark)
    tokenfiles.write_tokens(none, path, "words", 2, empty)
    assert tokenfiles.read_tokens(spark, empty).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (7, 1), (1000, 1 << 16), (4096, 1 << 32), (64, 1)):
        x = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        x[::17] = np.uint32(top - 1)
        assert (tokenfiles.decode_block(tokenfiles.encode_block(x)) == x).all()
    parts = [rng.integers(0, 50000, k, dtype=np.uint64).astype(np.uint32) for k in (3, 0, 9000, 1)]
    raw = tokenfiles.encode_segment(parts)
    assert all((a == b).all() for a, b in zip(tokenfiles.decode_segment(raw), parts, strict=True))
    assert (tokenfiles.read_block(raw, 1) == np.concatenate(parts)[4096:8192]).all()
    assert tokenfiles.decode_segment(tokenfiles.encode_segment([])) == []


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)  # cells of many blocks
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    near = [base[k % 5] * rng.uniform(0.1, 9) + rng.standard_normal(16) * 0.03 for k in range(60)]
    vectors = [v.tolist() for v in (*base, *near)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0, 2.0], [1e200] * 16]
    rows = [(k, v) for k, v in enumerate(vectors + odd)] + [(3, vectors[3]), (None, vectors[0])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    unit = np.array([np.array(v) / np.linalg.norm(v) if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all()
                     and any(v) and max(v) < 1e100 else np.zeros(16) for _, v in rows])
    links = [(a, b) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.95), strict=True) if a < b]
    root = brute.roots(range(len(rows)), links)
    n, low = Counter(x for p in links for x in p), {}
    for k, (i, _) in enumerate(rows):
        low[root[k]] = min((x for x in (low.get(root[k]), i) if x is not None), default=None)
    want = [(i, n[k], low[root[k]], i == low[root[k]]) for k, (i, _) in enumerate(rows)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(empty).count() == 0


def test_lattice_recall():
    """Pairs at a cosine of 0.95 exactly meet in at least one table."""
    rng = np.random.default_rng(2)
    u, w = rng.standard_normal((2, 2000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w -= (w * u).sum(1)[:, None] * u
    v = 0.95 * u + np.sqrt(1 - 0.95 ** 2) * w / np.linalg.norm(w, axis=1)[:, None]
    tables = embedding_dedup.Settings().of(64)
    met = np.zeros(len(u), bool)
    for t in range(tables.tables):
        a, b = tables.cells(u, t), tables.cells(v, t)
        met |= (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)
    assert met.mean() > 0.99


def test_quality(spark, docs, rows, none):
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.with_scores(table, labels).collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(got[i]["score"], q) for i, q, _ in labels.collect() if got[i]["held_out"]]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    some = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0), (13, 0, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.with_scores(docs, some)
    assert out.count() == len(rows) and out.filter("score is null or isnan(score)").count() == 0
    assert quality.with_scores(none, some).count() == 0
    assert {r["score"] for r in quality.with_scores(docs, some.limit(0)).collect()} == {0.5}


def test_quality_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95
