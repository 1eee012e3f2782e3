"""One query per operator, as the contracts fix it, and its SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F
from . import embedding_dedup, exact_dedup, jaccard, line_dedup, mixing, quality, quality_rules, ranked_search, sequences, substring_dedup, suffix_dedup, tokenfiles, vector_codes

QUERIES, ORACLES = {}, {}
SPACE_SQL = r"\x20\x09-\x0D"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_best_fit_packing")
def op1(spark, sf):
    return sequences.packed_pieces(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "leading", end_id=0, capacity=2048)


MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE_SQL}]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_no FROM totals),
capped AS (SELECT *, CAST([5, 2, 1][1 + source_no % 3] AS DOUBLE) AS w, source_size * CAST(3 AS DOUBLE) AS cap FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () * CAST(1 AS DOUBLE) - coalesce(sum(cap) OVER (
    ORDER BY cap / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
one AS (SELECT level AS t FROM levels WHERE level * w <= cap ORDER BY cap / w, source_no LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(cap, t * w), cap) AS target FROM levels LEFT JOIN one ON true),
placed AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CAST(floor(target + 0.5) AS BIGINT) AS budget
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epoch FROM placed)
SELECT doc_id, size, source_size, target,
  CAST(epoch * size + greatest(0, least(size, budget - epoch * source_size - before)) AS BIGINT) AS taken FROM epochs"""


@query("op2_mixing", MIX_SQL)
def op2(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), weights=(5, 2, 1), most=3, share=1.0).drop("tie")


LINES_SQL = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, r, i, lines[i] AS line,
    translate(regexp_replace(regexp_replace(lines[i], '^[{SPACE_SQL}]+', ''), '[{SPACE_SQL}]+$', ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, r, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
first AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT lines.*, first.first IS NOT NULL AND doc_id <> first.first AS gone FROM lines LEFT JOIN first USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r"""


@query("op4_line_dedup", LINES_SQL)
def op4(spark, sf):
    return line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"), least=10).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


COPIES_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)"""


@query("op7_exact_dedup", COPIES_SQL)
def op7(spark, sf):
    return exact_dedup.mark_duplicates(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op8_token_files")
def op8(spark, sf):
    path = tokenfiles.token_folder(spark)
    tokenfiles.write_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), "words", 2, path)
    return tokenfiles.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")



@query("op10_quality_classifier")
def op10(spark, sf):
    return quality.with_scores(table(spark, sf, "documents"), table(spark, sf, "labels"), threshold=0.3).select(
        "doc_id", "held_out", "score", "predicted")


@query("op3_ngram_jaccard")
def op3(spark, sf):
    return jaccard.near_groups(table(spark, sf, "documents"), width=4, percent=85)


@query("op6_substring_dedup")
def op6(spark, sf):
    return substring_dedup.dedup_words(table(spark, sf, "documents").select("doc_id", "text"), window=50).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_embedding_dedup")
def op5(spark, sf):
    return embedding_dedup.near_vectors(table(spark, sf, "embeddings"), least=0.95)


@query("op9_suffix_dedup")
def op9(spark, sf):
    return suffix_dedup.dedup_bytes(table(spark, sf, "documents").select("doc_id", "text"), least=400).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"))


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Lloyd rounds written out.  Doubles hold all products exactly."""
    steps = [f"""
kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r,
    [CAST(floor({scale} * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pieces AS MATERIALIZED (SELECT r, vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x
  FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (SELECT p, r AS k, x AS c FROM pieces WHERE r < {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""
near{n} AS MATERIALIZED (SELECT r, vec_id, label, pieces.p AS p, x,
    min({{'d': list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c), 'k': k}}) AS best
  FROM pieces JOIN book{n} ON pieces.p = book{n}.p GROUP BY ALL)""")
        if n < rounds:
            steps.append(f"""
mean{n} AS (SELECT p, k, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS c FROM (
  SELECT p, best.k AS k, i, sum(x[i]) AS s, count(*) AS n
  FROM near{n}, (SELECT unnest(range(1, 4097)) AS i) WHERE i <= len(x) GROUP BY ALL) GROUP BY p, k),
book{n + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN mean{n} m USING (p, k))""")
    return "WITH " + ",".join(steps) + f""",
sums AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, CAST(sum(best.d) AS BIGINT) AS error,
    string_agg(lower(lpad(to_hex(best.k), 2, '0')), '' ORDER BY p) AS code FROM near{rounds} GROUP BY r),
whole AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, i)) AS codebooks_sha256
  FROM book{rounds}, (SELECT unnest(range(1, 4097)) AS i) WHERE i <= len(c))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM sums, whole"""


@query("op11_vector_codes", codes_sql())
def op11(spark, sf):
    return vector_codes.with_label_errors(*vector_codes.compress(table(spark, sf, "embeddings")))


TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SEARCH_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, {LOWER_SQL}), '{TERM_SQL}') AS terms FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
sizes AS (SELECT r, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, whole GROUP BY term, docs),
asked AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT item_id, row_number() OVER () AS i,
    unnest(regexp_extract_all(translate(text, {LOWER_SQL}), '{TERM_SQL}')) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT i, item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (r), whole GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""


@query("op12_ranked_search", SEARCH_SQL)
def op12(spark, sf):
    return ranked_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), top=10)


@query("op13_quality_rules")
def op13(spark, sf):
    return quality_rules.rules(table(spark, sf, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
