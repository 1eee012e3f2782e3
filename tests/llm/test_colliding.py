"""Texts made so that sums of powers modulo 2**64 collide under every base: the
two symbol orders of a Thue-Morse sequence over the same filler."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playbill.llm import jaccard, mixing, sequences, substring_dedup, suffix_dedup, tokens
from tests.llm import brute


def twins(n, symbols, filler):
    order = [bin(k).count("1") % 2 for k in range(n)]
    r = random.Random(7)
    fill = [r.choice(filler) for _ in range(n)]
    return [[x for f, k in zip(fill, order, strict=True) for x in (f, symbols[k ^ flip])] for flip in (0, 1)]


@pytest.fixture(scope="module")
def letters():
    return ["".join(t) for t in twins(4096, "ab", "cdefghijklmnop")]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bytes(spark, letters):
    got = suffix_dedup.dedup_bytes(table(spark, letters)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept_bytes", 256))
    assert sorted(map(tuple, got.collect())) == brute.substrings(list(enumerate(letters)), 400)


@pytest.mark.parametrize("many", [20_000, 1])
def test_bytes_of_one_anchor(spark, letters, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    texts = [x[:2000] + "common " * 30 + x[2000:] for x in letters]
    got = suffix_dedup.dedup_bytes(table(spark, texts)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept_bytes", 256))
    assert sorted(map(tuple, got.collect())) == brute.substrings(list(enumerate(texts)), 400)


def test_words(spark):
    texts = [" ".join(t) for t in twins(2048, ("yes", "no"), [f"w{k}" for k in range(60)])]
    got = substring_dedup.dedup_words(table(spark, texts)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(tuple, got.collect())) == brute.windows(list(enumerate(texts)), 50)


def test_long_words(spark, letters):
    texts = [f"{x} one" for x in letters] + [f"{letters[0]} one"]
    assert sorted(map(tuple, jaccard.near_groups(table(spark, texts), 4, 85).collect())) == brute.near_groups(list(enumerate(texts)), 4, 85)
    line = [f"{x} " * 60 for x in letters]
    got = substring_dedup.dedup_words(table(spark, line)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(tuple, got.collect())) == brute.windows(list(enumerate(line)), 50)


@pytest.mark.parametrize(("file", "units"), [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "words")])
def test_ids(letters, file, units):
    model = Tokenizer.from_file(public_tokenizers.path(file))
    texts = [f"x {t}" for t in letters]
    for k, ids in tokens.Encoder(public_tokenizers.path(file), units).encode(pa.array(texts)):
        assert ids.tolist() == model.encode(texts[k], add_special_tokens=False).ids


def test_special_tokens_are_what_the_library_makes_of_them(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["hello <|endoftext|> world", "hello<|endoftext|>", "plain", "<|ENDOFTEXT|>", "<|endoftext|", None]
    model = Tokenizer.from_file(path)
    for k, ids in tokens.Encoder(path, "leading").encode(pa.array(texts)):
        assert ids.tolist() == model.encode(texts[k] or "", add_special_tokens=False).ids
    got = sequences.packed_pieces(table(spark, texts), path, capacity=64).collect()
    assert {r["doc_id"]: r["length"] for r in got} == {k: len(model.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in enumerate(texts)}


def test_mixing_keeps_rows_that_share_an_id_apart(spark):
    rows = [(1, "a b c", "", 1), (1, "a b c", None, 1), (1, "a b c", None, 2), (1, "a b c", "s", 3), (1, "a b c", "s", 3), (1, None, "s", 3), (1, "", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken = mixing.mix(docs, weights=(1, 1, 1)).filter("taken > 0").groupBy("source_size").agg(F.sum("taken").alias("n")).collect()
    got = mixing.mixed_documents(docs, weights=(1, 1, 1))
    assert got.columns == docs.columns
    by = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert set(by) == {"", None, "s"} and sum(by.values()) == sum(r["n"] for r in taken)
    assert {r["n_chars"] for r in got.filter("source is null").collect()} == {1, 2}
