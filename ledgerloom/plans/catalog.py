"""Registered queries: every operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text, values
from ledgerloom.functions.similarity import word_jaccard, word_overlap
from ledgerloom.lineage import checkpoint, shared_folder
from ledgerloom.matching import scoring
from ledgerloom.operators import anomalies, clean, documents, monthly, summary, vectors
from ledgerloom.operators import responses as extraction
from ledgerloom.operators.vector_index import VectorIndex
from ledgerloom.plans import analysis, bindings, reconcile
from ledgerloom.sources import ledgers, sessions, sinks

Query = Callable[[SparkSession, str], DataFrame]
FORMATS = ("MM/dd/yyyy",)


def _r(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: values.half_up(F.col(n), places) for n in names})


def _month_text(df: DataFrame) -> DataFrame:
    return df.withColumn("month", values.month_text(F.col("month")))


def _ledger(op, *args, **kw) -> Query:
    return lambda spark, sf: op(bindings.ledger(spark, sf), *args, **kw)


def _monthly(op, *names: str, places: int = 4, **kw) -> Query:
    return lambda spark, sf: _r(_month_text(op(bindings.ledger(spark, sf), **kw)), places, *names)


def clean_ledger(spark, sf):
    rows = clean.clean_ledger(bindings.dirty_ledger(spark, sf), FORMATS)
    return rows.select("txn_id", "date", "vendor", "amount", "category")


def reject_count(spark, sf):
    return clean.reject_count(clean.coerce(bindings.dirty_ledger(spark, sf), FORMATS))


def standardised(spark, sf):
    rows = bindings.ledger(spark, sf).drop("category")
    return clean.for_index(rows).select("txn_id", "vendor", "category", "description")


def prepared_for_matching(spark, sf):
    raw = bindings.dirty_ledger(spark, sf)
    return clean.prepare_for_matching(raw, "csv").select("txn_id", "source", "date", "amount", "vendor")


def clean_text(spark, sf):
    return _names(spark, sf).select("txn_id", text.clean_text(F.col("name")).alias("cleaned"))


def standard_vendor(spark, sf):
    return _names(spark, sf).select("txn_id", text.standard_vendor(F.col("name")).alias("vendor"))


def _names(spark, sf):
    rows = bindings.ledger(spark, sf)
    t = F.col("txn_id")
    ending = F.when(t % 4 == 0, "  llc").when(t % 4 == 1, " & co").when(t % 4 == 2, " and the sons inc").otherwise("'s at&t")
    return rows.select("txn_id", F.concat(F.lit(" the "), "vendor", ending).alias("name"))


def mom(spark, sf):
    rows = anomalies.month_over_month(bindings.ledger(spark, sf))
    return _r(_month_text(rows), 6, "total_amount", "previous_amount", "change")


def category_deviation(spark, sf):
    rows = anomalies.category_deviation(bindings.ledger(spark, sf))
    return _r(_month_text(rows), 4, "total_amount", "prior_mean", "z_score")


def seasonal(spark, sf):
    rows = anomalies.seasonal_spikes(bindings.ledger(spark, sf), factor=1.1)
    return _r(_month_text(rows), 4, "total_amount", "other_years_mean")


def all_anomalies(spark, sf):
    rows = anomalies.anomalies(bindings.ledger(spark, sf))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("findings"))


def monthly_stats(spark, sf):
    rows = monthly.monthly_stats(bindings.ledger(spark, sf))
    return _r(_month_text(rows), 4, "average_amount")


def month_large(spark, sf):
    rows = monthly.month_large_txns(bindings.ledger(spark, sf))
    return _r(_month_text(rows), 4, "p95").select("month", "txn_id", "date", "vendor", "amount", "p95")


def amount_outliers(spark, sf):
    rows = anomalies.amount_outliers(bindings.ledger(spark, sf), spread=0.5)
    return _r(rows, 4, "fence").select("txn_id", "category", "amount", "fence")


def responses_parsed(rules: str) -> Query:
    def run(spark, sf):
        found = extraction.parse_responses(bindings.responses(spark, sf), rules)
        return found.select(
            "session_id", "filename", "position", "date", "amount", "vendor", "description", "type", "source"
        )

    return run


def envelope(spark, sf):
    return extraction.extraction_envelope(bindings.responses(spark, sf))


def _sides(spark, sf, session="customer"):
    rows = bindings.ledger(spark, sf, session)
    return rows, bindings.statement(rows)


def _run(spark, sf, session="customer", profile="deployed"):
    return reconcile.reconcile(*_sides(spark, sf, session), profile)


def _near_pairs(spark, sf, rules, days: int) -> DataFrame:
    """Pairs of one session at most ``days`` apart, found by an equi-join on the day."""
    led, stm = reconcile.prepared(*_sides(spark, sf), rules)
    day = F.col("s_date")
    spread = stm.withColumn("day", F.explode(F.sequence(F.date_sub(day, days), F.date_add(day, days))))
    return spread.join(led.withColumn("day", F.col("l_date")), ["session_id", "day"])


def score_pairs(spark, sf):
    rules = scoring.Deployed()
    return rules.add_scores(_near_pairs(spark, sf, rules, 3)).select("session_id", "stmt", "led", "a", "d", "v", "e", "score")


def score_components_graded(spark, sf):
    rules = scoring.Graded()
    pairs = _near_pairs(spark, sf, rules, 6)
    words = {c: text.word_set(F.col(c)) for c in ("l_vendor", "s_vendor", "l_description", "s_description")}
    return pairs.select(
        "session_id",
        "stmt",
        "led",
        rules.amount_score().alias("amount_score"),
        F.round(rules.date_score(), 6).alias("date_score"),
        F.round(word_jaccard(words["l_vendor"], words["s_vendor"]), 6).alias("vendor_words"),
        F.round(F.coalesce(word_overlap(words["l_description"], words["s_description"]), F.lit(0.0)), 6).alias("description_words"),
    )


def best_match(spark, sf):
    return reconcile.best_matches(*_sides(spark, sf))


MATCH_COLUMNS = (
    "session_id", "statement_txn_id", "ledger_txn_id", "amount_score", "date_score", "vendor_score",
    "description_score", "confidence_score", "match_type", "tier", "recommendation",
)


def reconcile_matches(spark, sf):
    return _run(spark, sf).matches.select(*MATCH_COLUMNS)


def reconcile_large_sessions(spark, sf):
    return _run(spark, sf, "nation").matches.select(*MATCH_COLUMNS)


def reconcile_unmatched(spark, sf):
    return reconcile.display_unmatched(_run(spark, sf).unmatched())


def reconcile_summary(spark, sf):
    return _run(spark, sf).summary()


def reconcile_metric_rows(spark, sf):
    return reconcile.metric_rows(_run(spark, sf).summary())


def reconcile_display(spark, sf):
    return reconcile.display_matches(_run(spark, sf).detailed())


def reconcile_documents(spark, sf):
    return _run(spark, sf).documents()


def reconcile_nested(spark, sf):
    """Every session's result as one JSON document, in parts of four records."""
    return _run(spark, sf).nested_documents(records_per_part=4)


def reconcile_sparse(spark, sf):
    return reconcile.reconcile(*bindings.sparse_sides(spark, sf)).matches.select(*MATCH_COLUMNS)


def reconcile_sparse_unmatched(spark, sf):
    rows = reconcile.reconcile(*bindings.sparse_sides(spark, sf)).unmatched()
    return rows.select("session_id", "txn_id", "source", "date", "vendor", "amount", "description")


def sparse_sessions(spark, sf):
    """Sessions with rows on both sides, of ledgers and statements that lack some."""
    return reconcile.sessions_with_both_sides(*bindings.sparse_sides(spark, sf))


def vendor_from_description(spark, sf):
    """A ledger without a vendor column takes vendors from its descriptions."""
    rows = bindings.ledger(spark, sf).drop("vendor")
    return clean.for_index(clean.vendor_default(rows)).select("txn_id", "vendor", "category", "description")


def reconcile_graded(spark, sf):
    return _run(spark, sf, profile="graded").matches.select(*MATCH_COLUMNS)


def reconcilable_sessions(spark, sf):
    return reconcile.sessions_with_both_sides(*_sides(spark, sf))


def index_texts(spark, sf):
    rows = bindings.ledger(spark, sf)
    return rows.select("txn_id", documents.index_text(rows).alias("text"))


def txn_documents(spark, sf):
    docs = documents.transaction_documents(bindings.ledger(spark, sf))
    return docs.select("doc_id", "document_type", "text", "metadata.category", "metadata.date", "metadata.amount")


def monthly_documents(spark, sf):
    docs = documents.monthly_documents(bindings.ledger(spark, sf))
    return docs.select("doc_id", "document_type", "text", "metadata.period", "metadata.year", "metadata.month", "metadata.top_category")


def index_stats(spark, sf):
    rows = bindings.ledger(spark, sf)
    return documents.index_stats(rows, include_transactions=True)


def _first_vector(spark, sf):
    """The index, and the vector of its first text as the question."""
    index = bindings.vector_index(spark, sf)
    texts = bindings.ledger(spark, sf).select("txn_id", documents.index_text(bindings.ledger(spark, sf)).alias("text"))
    # Only the one text is embedded a second time.
    return index, vectors.embed_text(texts.agg(F.min_by("text", "txn_id").alias("text"))).select("embedding").scalar()


def similar(spark, sf):
    index, query = _first_vector(spark, sf)
    found = vectors.similar_transactions(index, query)
    return found.select("doc_id", "text", "amount", F.round("similarity", 6).alias("similarity"))


def retrieval_context(spark, sf):
    index, query = _first_vector(spark, sf)
    return vectors.retrieval_context(vectors.similar_transactions(index, query))


def _label_means(spark, sf) -> DataFrame:
    """(query_id, vector): the mean vector of every label."""
    return (
        bindings.table(spark, sf, "embeddings")
        .select("label", F.posexplode("embedding"))
        .groupBy("label", "pos")
        .agg(F.round(F.avg("col"), 6).alias("m"))
        .groupBy(F.col("label").cast("string").alias("query_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))
    )


def similar_to_labels(spark, sf):
    """Nearest ledger rows of every label's mean vector."""
    found = vectors.similar_batch(bindings.vector_index(spark, sf), _label_means(spark, sf))
    return found.select("query_id", "rank", "doc_id", F.round("similarity", 6).alias("similarity"))


def _new_index(spark) -> VectorIndex:
    return VectorIndex(spark, f"{shared_folder(spark).rstrip('/')}/vector-index-{uuid.uuid4().hex}")


def _line_index(spark, sf) -> VectorIndex:
    """A kept index over every ledger row's text."""
    rows = bindings.ledger(spark, sf)
    index = _new_index(spark)
    index.build(rows.select(F.col("txn_id").alias("doc_id"), "amount", documents.index_text(rows).alias("text")))
    return index


def index_search(spark, sf):
    """The rows most like the first one, from the lists that can hold them."""
    index = _line_index(spark, sf)
    first = index.documents().agg(F.min_by("embedding", "doc_id").alias("v")).collect()[0]["v"]
    return index.search(first).select("doc_id", "text", "amount", F.round("similarity", 6).alias("similarity"))


def index_search_batch(spark, sf):
    found = _line_index(spark, sf).search_batch(_label_means(spark, sf))
    return found.select("query_id", "rank", "doc_id", F.round("similarity", 6).alias("similarity"))


def _indexed_documents(spark, sf) -> DataFrame:
    """Monthly and transaction documents, rendered once."""
    return checkpoint(documents.ledger_documents(bindings.ledger(spark, sf), include_transactions=True))


def document_index(spark, sf):
    """Every document of an index built from the transactions, then from all documents, and
    how many documents a third build embeds again."""
    docs = _indexed_documents(spark, sf)
    index = _new_index(spark)
    index.build(docs.where("document_type = 'transaction'"), whole=False)
    index.build(docs)
    again = index.build(docs)
    return index.documents().select("doc_id", "document_type", "digest", F.lit(again.embedded).alias("embedded_again"))


def document_query(spark, sf):
    """The documents most like a question about each category."""
    asked = bindings.table(spark, sf, "part").select(F.col("p_type").alias("query_id")).distinct()
    asked = asked.withColumn("text", F.concat(F.lit("Transaction record of category: "), "query_id"))
    questions = vectors.embed_text(asked).select("query_id", F.col("embedding").alias("vector"))
    index = _new_index(spark)
    index.build(_indexed_documents(spark, sf))
    found = index.search_batch(questions)
    return found.select("query_id", "rank", "doc_id", F.round("similarity", 6).alias("similarity"))


def hashed_embeddings(spark, sf):
    made = vectors.embed_text(index_texts(spark, sf))
    return made.select("txn_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


def csv_rows(spark, sf):
    """Ledger rows as CSV lines in a column, parsed again."""
    amount = F.col("amount").cast("decimal(18,2)").cast("string")
    line = F.concat_ws(",", F.col("date").cast("string"), "vendor", amount, "category").alias("line")
    lines = bindings.ledger(spark, sf).select("txn_id", line)
    return ledgers.csv_from_column(lines, "line", ["date", "vendor", "amount", "category"])


def ledger_documents(spark, sf):
    docs = documents.ledger_documents(bindings.ledger(spark, sf), include_transactions=True)
    return docs.select("doc_id", "document_type", "text")


def _read_scans(batches):
    """Stands for a model: answers every image with the words its bytes spell."""
    for scans in batches:
        words = scans["content"].map(lambda b: bytes(b).decode().split("|"))
        answers = words.map(lambda w: f'[{{"vendor": "{w[0]}", "amount": {w[1]}}}]')
        yield scans[["session_id", "filename"]].assign(response=answers)


def extract_responses(spark, sf):
    amount = F.col("amount").cast("decimal(18,2)").cast("string")
    scans = bindings.ledger(spark, sf).select(
        "session_id",
        F.col("txn_id").cast("string").alias("filename"),
        F.encode(F.concat_ws("|", "vendor", amount), "UTF-8").alias("content"),
    )
    answers = extraction.extract_responses(scans, _read_scans, "session_id long, filename string, response string")
    return extraction.parse_responses(answers).select("session_id", "filename", "vendor", "amount")


def session_catalog(spark, sf):
    return sessions.session_catalog(bindings.ledger(spark, sf), "date")


def session_count(spark, sf):
    return sessions.session_count(bindings.ledger(spark, sf))


def records(spark, sf):
    return sinks.records(bindings.ledger(spark, sf))


def _raw(op, *args) -> Query:
    return lambda spark, sf: op(bindings.dirty_ledger(spark, sf), *args)


def analyze_ledger(spark, sf):
    return analysis.analyze_ledger(bindings.dirty_ledger(spark, sf), FORMATS).sections()


QUERIES: dict[str, Query] = {
    "analyze_ledger": analyze_ledger,
    "analyze_categories": _raw(analysis.spending_by_category),
    "analyze_category": _raw(analysis.spending_by_category, "eco"),
    "analyze_vendors": _raw(analysis.vendor_analysis),
    "analyze_vendor": lambda s, d: _r(analysis.vendor_analysis(bindings.dirty_ledger(s, d), "GIZMO"), 4, "average_amount"),
    "clean_ledger": clean_ledger,
    "reject_count": reject_count,
    "standardised": standardised,
    "prepared_for_matching": prepared_for_matching,
    "ledger_summary": lambda s, d: _r(summary.ledger_summary(bindings.ledger(s, d)), 4, "average_amount"),
    "session_summary": lambda s, d: _r(summary.ledger_summary(bindings.ledger(s, d), ["session_id"]), 4, "average_amount"),
    "summary_text": _ledger(summary.summary_text),
    "top_vendors": _ledger(summary.top_vendors, 5),
    "top_categories": _ledger(summary.top_categories, 3),
    "category_breakdown": _ledger(summary.category_breakdown),
    "spending_by_category": _ledger(summary.spending_by_category),
    "category_detail": _ledger(summary.category_detail, "eco"),
    "category_total": _ledger(summary.category_total, "eco"),
    "vendor_stats": _ledger(summary.vendor_stats),
    "vendor_detail": _ledger(summary.vendor_detail, "GIZMO"),
    "vendor_total": lambda s, d: _r(summary.vendor_total(bindings.ledger(s, d), "GIZMO"), 4, "average_amount"),
    "monthly_stats": monthly_stats,
    "month_category": _monthly(monthly.month_category),
    "month_top_category": _monthly(monthly.month_top_category),
    "month_top_vendors": _monthly(monthly.month_top_vendors),
    "month_frequent_vendors": _monthly(monthly.month_frequent_vendors),
    "month_p95": _monthly(monthly.month_p95, "p95"),
    "month_large_txns": month_large,
    "month_daily": _monthly(monthly.month_daily),
    "anomaly_mom": mom,
    "anomaly_new_vendor": _monthly(anomalies.new_vendors),
    "anomaly_category": category_deviation,
    "anomaly_amount": amount_outliers,
    "anomaly_frequency": _monthly(anomalies.frequency_spikes, "prior_mean"),
    "anomaly_seasonal": seasonal,
    "anomalies": all_anomalies,
    "clean_text": clean_text,
    "standard_vendor": standard_vendor,
    "parse_responses": responses_parsed("deployed"),
    "parse_responses_strict": responses_parsed("strict"),
    "extraction_envelope": envelope,
    "score_pairs": score_pairs,
    "score_components_graded": score_components_graded,
    "best_match": best_match,
    "reconcile_matches": reconcile_matches,
    "reconcile_large_sessions": reconcile_large_sessions,
    "reconcile_unmatched": reconcile_unmatched,
    "reconcile_summary": reconcile_summary,
    "reconcile_metric_rows": reconcile_metric_rows,
    "reconcile_display": reconcile_display,
    "reconcile_documents": reconcile_documents,
    "reconcile_nested": reconcile_nested,
    "reconcile_sparse": reconcile_sparse,
    "reconcile_sparse_unmatched": reconcile_sparse_unmatched,
    "sparse_sessions": sparse_sessions,
    "vendor_from_description": vendor_from_description,
    "reconcile_graded": reconcile_graded,
    "reconcilable_sessions": reconcilable_sessions,
    "index_texts": index_texts,
    "txn_documents": txn_documents,
    "monthly_documents": monthly_documents,
    "index_stats": index_stats,
    "similar_transactions": similar,
    "retrieval_context": retrieval_context,
    "similar_to_labels": similar_to_labels,
    "index_search": index_search,
    "index_search_batch": index_search_batch,
    "document_index": document_index,
    "document_query": document_query,
    "hashed_embeddings": hashed_embeddings,
    "csv_rows": csv_rows,
    "ledger_documents": ledger_documents,
    "extract_responses": extract_responses,
    "session_catalog": session_catalog,
    "session_count": session_count,
    "records": records,
}
