"""Registered queries of the corpus operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    decontam,
    exact,
    licenses,
    packing,
    pii,
    quality,
    runs,
    search,
    simhash,
    token_counts,
    token_files,
    toxicity,
    warc,
)

END_ID = 2
FILE_END_ID = 1
TOKEN_LIMIT = 2048
TOXIC, GOOD = 0.7, 0.3


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    return packing.packed_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), END_ID)


def toxicity_model(spark, sf_dir) -> toxicity.Model:
    """Learnt from the labelled documents outside the held-out third."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.fit(toxicity.training(docs, labels, toxicity.is_held_out(3, 1), "toxic"))


def _judged(scores: DataFrame, modulus: int, remainder: int, least: float) -> DataFrame:
    return scores.select(
        "doc_id",
        toxicity.is_held_out(modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def op2_toxicity(spark, sf_dir):
    scores = toxicity.score(_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return _judged(scores, 3, 1, TOXIC)


def op3_quality(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(toxicity.training(docs, labels, toxicity.is_held_out(5, 0), "quality"))
    return _judged(quality.score(docs, model), 5, 0, GOOD)


def op4_token_files(spark, sf_dir):
    return token_files.token_file_rows(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), FILE_END_ID)


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op6_licenses(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op7_exact(spark, sf_dir):
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_decontam(spark, sf_dir):
    return decontam.judged(decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_warc(spark, sf_dir):
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op10_token_counts(spark, sf_dir):
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_pii(spark, sf_dir):
    found = pii.personal_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op12_search(spark, sf_dir):
    return search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def planted_repeats(doc_id: object, words: list[bytes]) -> list[bytes]:
    """Of a tenth of the documents, chosen by id, the words from some place on repeat."""
    import zlib

    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def op13_runs(spark, sf_dir):
    return runs.run_report(_table(spark, sf_dir, "documents"), rewrite=planted_repeats).drop("collapsed")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_simhash": op5_simhash,
    "op6_licenses": op6_licenses,
    "op7_exact": op7_exact,
    "op8_decontam": op8_decontam,
    "op9_warc": op9_warc,
    "op10_token_counts": op10_token_counts,
    "op11_pii": op11_pii,
    "op12_search": op12_search,
    "op13_runs": op13_runs,
    "pipeline": pipeline,
}

# A text is lower-cased by bytes, so that only A-Z change.
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
WITH n AS (SELECT doc_id, {_LOWER.format("text")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

OP8_SQL = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, list_slice(w, k, k + 12) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT len(win) AS n FROM win),
place AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM doc, sizes WHERE len(w) >= n
), hit AS (
  SELECT p.doc_id, p.k, p.n, win.item_id FROM (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS win FROM place) p JOIN win ON p.win = win.win
), words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN words h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

OP12_SQL = f"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
sums AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), sums),
part AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))) AS part
  FROM tf JOIN n USING (doc_id) JOIN w USING (term), sums
), q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), s AS (
  SELECT item_id, doc_id, CAST(sum(part * times) AS BIGINT) AS score FROM part JOIN q USING (term) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {
    "op6_licenses": licenses.scan_sql(),
    "op7_exact": OP7_SQL,
    "op8_decontam": OP8_SQL,
    "op12_search": OP12_SQL,
}
