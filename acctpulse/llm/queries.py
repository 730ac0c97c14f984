"""The registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctpulse.llm import alignment, byte_bpe, decontamination, fill_in_middle, licenses, mixing, near_duplicates, quality_model, quality_rules, repeats, secret_scan, token_counts, toxicity
from acctpulse.llm.labels import fold
from acctpulse.session import materialize
from acctpulse.sources.tables import read_table

#: Tokens that fit a context window.
CONTEXT = 512
#: Scores from which a document counts as good, and as toxic.
GOOD, TOXIC = 0.3, 0.5


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans of each document, and the digest of what is left."""
    left = repeats.remove(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return left.select(
        "doc_id",
        F.col("rp_bytes").alias("n_bytes"),
        F.col("rp_removed").alias("n_removed"),
        F.col("rp_spans").alias("n_spans"),
        F.sha2("rp_kept", 256).alias("kept_sha256"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of each document, with the blocks that state them and how their wording differs."""
    found = licenses.scan_rows(read_table(spark, sf_dir, "documents"), ["doc_id"])
    names = {"li_blocks": "n_blocks", "li_names": "licenses", "li_found": "blocks", "li_differences": "differences"}
    return found.withColumnsRenamed(names)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, as they stand and in unwrapped layers."""
    found = secret_scan.scan_rows(read_table(spark, sf_dir, "documents"), ["doc_id"])
    names = {"sc_assign": "n_assign", "sc_access": "n_access", "sc_hex": "n_hex", "sc_base": "base_sha256", "sc_spans": "spans"}
    return found.withColumnsRenamed({**names, "sc_found": "n_spans", "sc_refused": "n_refused"})


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each document, the class's size and the number of links of its text to other texts."""
    found = near_duplicates.classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_links")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document by the quality model."""
    measured = materialize(quality_model.measure(read_table(spark, sf_dir, "documents"), ["doc_id"]), "form")
    scored = quality_model.score(measured, quality_model.train(measured, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        F.col("qm_score").alias("score"),
        (F.col("qm_score") >= GOOD).cast("int").alias("predicted"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and when it is first due; in training order, documents never due last."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of().alias("size"))
    mixed = mixing.mix(materialize(docs, "sizes"), "size")
    return mixed.select(
        "doc_id",
        "size",
        F.col("mx_total").alias("source_size"),
        F.col("mx_target").alias("target"),
        F.col("mx_taken").alias("taken"),
        F.get("mx_times", F.lit(0)).alias("first_due"),
    ).orderBy(F.col("first_due").asc_nulls_last(), mixing.order_key())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the most similar window."""
    found = decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", F.col("start").alias("start_word"), F.col("n").alias("n_words"), "n_windows")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document by the two language models."""
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        F.col("tx_score").alias("score"),
        (F.col("tx_score") >= TOXIC).cast("int").alias("predicted"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of the adaptive rules for each document."""
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select(
        "doc_id",
        *[f"qr_m.{c}" for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()],
        F.col("qr_kept").alias("kept"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
    return counted.select(
        "doc_id",
        F.col("tc_bytes").alias("n_bytes"),
        F.col("tc_tokens").alias("n_tokens"),
        (F.col("tc_tokens") > CONTEXT).alias("over_limit"),
    )


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each document, and of the bytes they decode to."""
    import public_tokenizers

    merges = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = byte_bpe.decode(byte_bpe.encode(read_table(spark, sf_dir, "documents"), merges, ["doc_id"]), merges)
    return both.select(
        "doc_id",
        F.size("bb_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bb_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bb_bytes", 256).alias("decoded_sha256"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by two tokenizers, their groups and links, and how common the links are in all documents."""
    import public_tokenizers

    pair = alignment.read_pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found = alignment.link_counts(read_table(spark, sf_dir, "documents"), pair, ["doc_id"])
    names = {"ca_a": "n_a", "ca_b": "n_b", "ca_groups": "n_groups", "ca_links": "n_links", "ca_best": "n_best", "ca_sum": "count_sum"}
    return found.withColumnsRenamed({**names, "ca_written": "groups_sha256"})


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and cuts of each document, and digests of the output and of the text restored from it."""
    made = fill_in_middle.transform(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return made.select(
        "doc_id",
        F.col("fm_units").alias("n"),
        F.col("fm_form").alias("form"),
        F.col("fm_prefix").alias("prefix_chars"),
        F.col("fm_middle").alias("middle_chars"),
        F.sha2("fm_out", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_licenses": op2_licenses,
    "op3_secret_scan": op3_secret_scan,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality_model": op5_quality_model,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_alignment": op12_alignment,
    "op13_fill_in_middle": op13_fill_in_middle,
}
