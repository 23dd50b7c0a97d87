"""The operators of this package as queries over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occugrid.llm import (
    decontamination,
    importance,
    line_dedup,
    lsh_forest,
    mixture,
    ordinal,
    packing,
    pii,
    revisits,
    separators,
    weak_supervision,
    whitening,
    winnowing,
)
from occugrid.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), added_tokens=True))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = revisits.resolve(revisits.captures_of_pages(table(spark, sf_dir, "pages")))
    fields = F.transform("headers", lambda one: F.concat_ws("=", one["name"], one["value"]))
    return resolved.withColumn("headers", F.array_join(fields, ";")).withColumn(
        "page_id", F.floor(F.col("record_id") / 4)
    )


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = separators.count_documents(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_tokens")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_supervision.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("posterior", 9).alias("posterior"),
    )


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsh_forest.near_copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "class_id", "n_links")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.with_kept_text(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken(mixture.mix(table(spark, sf_dir, "documents")))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.detect(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    texts, toxic = ordinal.labelled_sample(docs, labels)
    model = ordinal.fit(texts, ordinal.grades_by_dose(texts, toxic), n_grades=4)
    return ordinal.predict(docs, model).select(
        "doc_id",
        F.round("expected", 6).alias("expected_severity"),
        F.col("grade").alias("severity"),
        F.round("p_above", 6).alias("p_toxic"),
        (F.col("p_above") >= ordinal.TOXIC).alias("toxic"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = winnowing.compare_edited(table(spark, sf_dir, "documents"), text=True)
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        F.col("next_id").alias("next_doc_id"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return importance.resample(weighed)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.fixed_point(table(spark, sf_dir, "embeddings"))
    model, distinct = whitening.fit(vectors)
    error = whitening.identity_error(model, distinct)
    return whitening.components(whitening.transform(vectors, model), model, error)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.contamination(found)


QUERIES: dict[str, Query] = {
    "op1_packed_sequences": op1_packed_sequences,
    "op2_revisits": op2_revisits,
    "op3_separator_scan": op3_separator_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_near_copies": op5_near_copies,
    "op6_line_dedup": op6_line_dedup,
    "op7_source_mixture": op7_source_mixture,
    "op8_personal_data": op8_personal_data,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_decontamination": op13_decontamination,
}
