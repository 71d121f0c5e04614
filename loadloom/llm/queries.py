"""The queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, html_text, jaccard_join, language_id, license_scan, packing, quality_rules, tandem_runs, toxicity, url_filters, warc, word_bpe
from .common import table


#: By this first line a document stands for its directory's licence file.
LICENSE_LINE = r"(?i)licen[sc]|copyright|public domain|creative commons"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"), carry=False)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return got.select("page_id", "host", "path", "rule", "verdict")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their source and language are directories; one whose text begins with a licence line is its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.substring_index("text", "\n", 1).rlike(LICENSE_LINE), F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    shelf = F.floor(F.col("doc_id") / 1000)
    path = F.concat_ws("/", "source", "lang", shelf, name)
    got = license_scan.scan(docs.select("doc_id", path.alias("path"), "text"))
    return got.select("doc_id", "path", "license", F.round("similarity", 6).alias("similarity"), "origin", "inherited_from")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    got = toxicity.score(docs, model)
    return got.select("doc_id", (~toxicity.teachable(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth text, by the hash of its id, repeats a stretch of its words from one of them on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", filter_audit.BLANK), "")))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.expr("try_mod(g, n)"))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tandem_runs.collapse(planted(table(spark, sf_dir, "documents")), carry=False)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    got = got.withColumns({"best": best, "lines": lines})
    length = -F.col("best.l")
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(language_id.teachable(F.col("doc_id"))))
    got = language_id.predict(docs.select("doc_id", "text"), model, carry=False)
    return got.select("doc_id", F.coalesce(~language_id.teachable(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_ngram_jaccard, op3_quality_rules, op4_exact_dedup, op5_url_filters, op6_packing, op7_word_bpe, op8_html_extraction, op9_license_scan, op10_toxicity, op11_periodic_runs, op12_language_id, op13_filter_audit)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.SQL, "op4_exact_dedup": exact_dedup.SQL, "op13_filter_audit": filter_audit.SQL}
