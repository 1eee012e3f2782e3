"""Statistics and trees of the quality classifier against versions that go row
by row, byte by byte and node by node."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from playbill.llm import quality
from tests.llm.test_operators import odd_rows, prose

CLASSES = {"spaces": " ", "breaks": "\n", "stops": ".,", "exclaims": "!?", "symbols": "#$%&*@^~+=|", "brackets": "<>{}[]()/\\"}


def by_byte(text):
    raw = (text or "").encode()
    words, n = raw.split(), len(raw)
    kinds = Counter()
    for b in raw:
        c = chr(b)
        found = [k for k, chars in CLASSES.items() if c in chars]
        found += [k for k, ok in (("upper", "A" <= c <= "Z"), ("lower", "a" <= c <= "z"), ("digits", "0" <= c <= "9"), ("non_ascii", b > 127)) if ok]
        kinds.update(found or ["others"])
    some, size = max(len(words), 1), max(n, 1)
    upper = lambda b: 65 <= b <= 90
    marks = (CLASSES["symbols"] + CLASSES["exclaims"]).encode()
    out = {k: kinds[k] / size for k in (*CLASSES, "upper", "lower", "digits", "non_ascii", "others")}
    out |= {"bytes": math.log1p(n), "words": math.log1p(len(words)), "word_bytes": sum(map(len, words)) / some,
            "longest_word": math.log1p(max(map(len, words), default=0)), "line_bytes": n / (raw.count(b"\n") + 1),
            "repeats": sum(a == b for a, b in zip(words[1:], words, strict=False)) / some,
            "repeats_2": sum(a == b for a, b in zip(words[2:], words, strict=False)) / some,
            "distinct": len(set(words)) / some, "most_common": max(Counter(words).values(), default=0) / some,
            "upper_words": sum(len(w) > 1 and upper(w[0]) and upper(w[-1]) for w in words) / some,
            "symbol_words": sum(w[-1] in marks for w in words) / some, "distinct_bytes": len(set(raw))}
    return [out[s] for s in quality.STATISTICS]


def test_statistics():
    texts = [r[1] for r in odd_rows()] + ["A", "AB ab AB AB", "!!! ??", "#a a#", "x\n\n\ny", prose(1, 4000) + "Q" * 70_000, "é" * 10, None, ""]
    got = quality.statistics(pa.array(texts))
    assert got.shape == (len(texts), len(quality.STATISTICS))
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(by_byte(text))


def test_trees_node_by_node():
    r = np.random.default_rng(3)
    x = np.round(r.standard_normal((300, 5)), 1)  # ties with thresholds
    model = quality.fit(x, ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float), trees=12, depth=3)

    def walk(row):
        total = model.base
        for feature, threshold, leaf in zip(model.feature.tolist(), model.threshold.tolist(), model.leaf.tolist(), strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert model.score(x).tolist() == pytest.approx([walk(row) for row in x.tolist()])
    assert model.score(x[:0]).shape == (0,)


def test_scores_are_those_of_the_model_row_by_row(spark):
    """Whole query on a small table: repeated ids with different texts, null
    ids and texts, a very long text; labels of the held-out fold unused."""
    r = random.Random(5)
    rows = [(k, prose(k, 60) if k % 2 else "JUNK!! " * r.randint(5, 40)) for k in range(120)]
    rows += [(3, "another text of id three"), (None, prose(999, 20)), (4, None), (5, prose(5, 20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(k, k % 2, 0) for k in range(120)] + [(None, 1, 0), (7, None, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, table)
    got = quality.with_scores(docs, table).collect()
    assert len(got) == len(rows)
    for x in got:
        want = model.score(np.array([by_byte(x["text"])]))[0]
        assert x["score"] == pytest.approx(want) and x["predicted"] == int(x["score"] >= quality.THRESHOLD)
        assert x["held_out"] == (x["doc_id"] is None or zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
    flipped = spark.createDataFrame([(i, q if i is None or q is None or zlib.crc32(str(i).encode()) % 5 else 1 - q, t) for i, q, t in labels],
                                    "doc_id long, quality int, toxic int")
    again = quality.train(docs, flipped)
    assert (again.leaf == model.leaf).all() and (again.threshold == model.threshold).all()
