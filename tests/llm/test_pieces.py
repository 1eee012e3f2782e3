"""Small parts of the operators on their own."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from playbill.llm import bwt, common, grams, lattice, packing, tokens
from tests.llm import brute

ODD = ["a", "B", "é", "ß", "İ", "ſ", " ", "  ", "\n", "\t", " \n", "\n ", ".", ",", "!", "'s", "'", "1", "²", "\x1c", "\xa0",
       " ", "<|endoftext|>", "ñ", "Σ", "日本", "😀", "-", "_", "\x00", "\x85", "I'll", "DON'T"]


@pytest.mark.parametrize(("file", "units"), [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "words"),
                                             ("byte_bpe_50k.json", "whole")])
def test_units_give_the_ids_of_the_text(file, units):
    r = random.Random(3)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["", None, " ", "x" * 5000]
    model = Tokenizer.from_file(public_tokenizers.path(file))
    code = tokens.Encoder(public_tokenizers.path(file), units, memory=300)
    for at in range(0, len(texts), 300):
        part = texts[at:at + 300]
        for k, ids in code.encode(pa.array(part, pa.string())):
            assert ids.tolist() == model.encode(part[k] or "", add_special_tokens=False).ids


def test_repeated_starts():
    r = random.Random(3)
    for _ in range(150):
        records = []
        for _ in range(r.randint(1, 8)):
            x = bytes(r.choice(b"ab\x00") for _ in range(r.randint(0, 60)))
            if records and r.random() < 0.6:
                o = r.choice(records)
                i = r.randint(0, len(o))
                x = x[:20] + o[i:i + r.randint(0, 40)] + x[20:]
            records.append(b"ab" * r.randint(0, 40) if r.random() < 0.2 else x)
        least = r.choice([7, 8, 9, 12, 20])
        times = Counter(x[i:i + least] for x in records for i in range(len(x) - least + 1))
        want = [[i for i in range(len(x) - least + 1) if times[x[i:i + least]] > 1] for x in records]
        assert [x.tolist() for x in bwt.repeated_starts(records, least)] == want


def test_window_minimum():
    r = np.random.default_rng(1)
    for n in (0, 3, 10, 57, 200):
        x = r.integers(0, 6, n).astype(np.uint64)
        for width in (1, 2, 7, 10):
            want = [i + int(np.argmin(x[i:i + width])) for i in range(n - width + 1)]
            assert grams.window_minimum(x, width).tolist() == want


def test_words():
    texts = ["a bc\td", "", None, "  x ", "y", "\n", "é ß"]
    for _, data, off in grams.slices(pa.array(texts), 4):
        w = grams.Words(data, off)
        rows = [[data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)]
                for a, b in zip(w.upto[:-1], w.upto[1:], strict=True)]
        assert all(x in [brute.WORD.findall(t or "") for t in texts] for x in rows)


def test_lattice_point_is_nearest():
    x = np.random.default_rng(0).standard_normal((500, 8)) * 2
    p = lattice.decode(x)
    assert len(lattice.SHORTEST) == 240
    assert (((p * 2) % 2).min(axis=1) == ((p * 2) % 2).max(axis=1)).all()
    d = ((x - p) ** 2).sum(1)
    assert (d[:, None] <= ((x[:, None] - p[:, None] - lattice.SHORTEST) ** 2).sum(2) + 1e-9).all()


def test_sweep_places_items_once():
    r = random.Random(2)
    for _ in range(50):
        items = {r.randint(1, 50): (r.randint(0, 9), r.randint(1, 30)) for _ in range(10)}
        gaps = {r.randint(1, 100): r.randint(1, 20) for _ in range(10)}
        matches = packing.successor_sweep(items, gaps)
        rows, after = packing.updated_gaps(matches, gaps)
        assert sum(after.values()) == sum(gaps.values()) == sum(hi - lo for _, lo, hi, *_ in rows)
        moved = sum(s * (hi - lo) for s, lo, hi, *_ in matches)
        assert sum(f * n for f, n in gaps.items()) - sum(f * n for f, n in after.items()) == moved
        for s, lo, hi, take, free, _ in matches:
            assert take * s <= free and items[s][0] <= lo < hi <= sum(items[s])


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 530)]
    got = dict(common.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == brute.roots(nodes, [e for e in edges if e[0] != e[1]])


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(r.choice([0, 0, 0, 1, 2]), k, r.randint(0, 9)) for k in range(400)]
    got = common.running_sums(spark.createDataFrame(rows, "g long, k long, v long"), "g", ["k"], "v", "sums")
    want = {(g, k): sum(v for g2, k2, v in rows if g2 == g and k2 < k) for g, k, _ in rows}
    assert {(x["g"], x["k"]): x["before"] for x in got.collect()} == want


def test_units_met_again_stay_when_memory_is_full(monkeypatch):
    """A full memory keeps the units met again: they are merged once."""
    monkeypatch.setattr(tokens, "TEXT", 256)
    code = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "leading", memory=60)
    asked, unit_ids = [], code._unit_ids
    code._unit_ids = lambda units: asked.extend(units) or unit_ids(units)
    letters = "abcdefghij"
    texts = ["common word " + " ".join(f"q{letters[k // 100]}{letters[k // 10 % 10]}{letters[k % 10]}{j * 'z'}" for j in range(20))
             for k in range(100)]
    rows = dict(code.encode(pa.array(texts)))
    assert asked.count("common") == asked.count(" word") == 1
    assert [rows[k].tolist() for k in range(100)] == [code._ids([t])[0] for t in texts]


def test_pipeline_bounds_the_words_of_its_encoder(monkeypatch):
    """The pipeline's workers remember far fewer words than an encoder on its own."""
    asked = {}
    monkeypatch.setattr(corpus_pipeline.sequences, "packed_pieces", lambda docs, *a, **k: asked.update(k))
    corpus_pipeline.pack_sequences(None, None, "")
    code = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"), "leading", asked["memory"])
    texts = pa.array([" ".join(f"{chr(97 + k % 26)}{n:x}" for n in range(k * 1000, k * 1000 + 1000)) for k in range(300)])
    for _ in code.encode(texts):
        pass
    assert len(code.known) < 250_000 and list(tokens._made.values()) == [code]
    tokens.drop_encoders()
    assert not tokens._made


def test_ends_of_few_intervals_need_no_pass_over_all_places(monkeypatch):
    """Prefixes longer than the first key are extended from their own intervals only."""
    r = random.Random(5)
    long = bytes(r.choice(b"abcdefgh") for _ in range(20_000))
    records = [long, long[:9000] + b"#" + long[9001:]]
    passes, all_places = [], np.flatnonzero
    monkeypatch.setattr(bwt.np, "flatnonzero", lambda x: passes.append(len(x)) or all_places(x))
    got = bwt.repeated_starts(records, 400)
    monkeypatch.undo()
    assert sum(n > 10_000 for n in passes) < 50
    for k, n in enumerate(map(len, records)):
        assert got[k].tolist() == [i for i in range(n - 399) if not i <= 9000 < i + 400]


def test_next_marked_place():
    marked = np.zeros(5001, bool)
    marked[[0, 3, 4, 2000, 5000]] = True
    assert bwt._next(marked, np.array([0, 1, 3, 4, 1999, 2000])).tolist() == [3, 3, 4, 2000, 2000, 5000]
    assert bwt._next(marked, np.arange(5000)).tolist() == [min(m for m in (0, 3, 4, 2000, 5000) if m > k) for k in range(5000)]
