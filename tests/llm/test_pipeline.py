"""The pipeline's stages, each against plain Python on its own input."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from playbill.llm.common import stored
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        seen.append(docs)
    for d in seen[1:-1]:
        assert tuple(d.columns) == corpus_pipeline.COLUMNS
    rows = [[(r[0], r[1]) for r in d.collect()] for d in seen]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in rows[1]}
    known = [i for i, _ in rows[0] if i in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in known) >= 0.9 * len(known)
    best = {}
    for i, t in rows[1]:
        best[t or ""] = max(i, best.get(t or "", i))
    assert sorted(i for i, _ in rows[2]) == sorted(best.values())
    groups = brute.near_groups(rows[2], 5, 80)
    assert sorted(i for i, _ in rows[3]) == sorted({c for _, _, c in groups})
    texts = dict(rows[3])
    assert all(texts[i] == t or texts[i].startswith(t) for i, t in rows[4])
    words = sum(len(brute.WORD.findall(t or "")) for _, t in rows[3])
    assert abs(sum(len(brute.WORD.findall(t or "")) for _, t in rows[4]) - words) <= len(set(s[3] for s in seen[3].collect()))
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows[4])
    assert sum(r["length"] for r in seen[5].collect()) == total


def test_stages_take_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and clashing columns go
    through every stage, as does an empty table."""
    from tests.llm.test_operators import SCHEMA, odd_rows
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, SF), name)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert tuple(out.columns) == corpus_pipeline.COLUMNS
            if docs is not odd:
                assert out.count() == 0
    rows = [(r[0], r[1]) for r in odd.collect()]
    stages = dict(corpus_pipeline.STAGES)
    best = {}
    for i, t in rows:
        best[t or ""] = max((x for x in (best.get(t or ""), i) if x is not None), default=None)
    got = stages["exact_dedup"](spark, odd, SF).collect()
    assert sorted(((r["doc_id"], r["text"] or "") for r in got), key=str) == sorted(((i, t) for t, i in best.items()), key=str)
    root = {i: c for i, _, c in brute.near_groups(rows, 5, 80)}
    got = stages["ngram_jaccard_join"](spark, odd, SF).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str((i, t)) for i, t in rows if i is None or root[i] == i)
