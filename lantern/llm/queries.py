"""The ten operators over whole tables: `opN_<name>`, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lantern.llm.tables import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document (`simhash.simhash_groups`)."""
    from lantern.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept and dropped line numbers of every document (`line_dedup.dedup_lines`)."""
    from lantern.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, by two runs over one ledger: an earlier snapshot of the English documents, and then all (`secrets.scan_versions`)."""
    from lantern.llm.secrets import scan_versions

    docs = table(spark, sf_dir, "documents")
    _, ledger = scan_versions(docs.where("lang = 'en'"))  # the run before: an English snapshot
    found, _ = scan_versions(docs, ledger)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_toxicity_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document (`toxicity.score_documents`)."""
    from lantern.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items and items of every document (`decontaminate.flag`)."""
    from lantern.llm.decontaminate import flag

    return flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page; aliases are what pages declare and what URL conventions state (`urls.judge`)."""
    from lantern.llm.urls import conventional_aliases, judge

    pages = table(spark, sf_dir, "pages")
    return judge(pages, conventional_aliases(pages))


def op7_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text stored as a Matroska file and read back (`matroska.media_features`)."""
    from lantern.llm.matroska import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op8_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is read, and its place in its source's permutation (`mixing.mixture`)."""
    from lantern.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document (`token_count.count_tokens`)."""
    from lantern.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards read back (`token_ids.token_binary`)."""
    from lantern.llm.token_ids import token_binary

    return token_binary(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_line_dedup,
        op3_secret_ledger,
        op4_toxicity_viterbi,
        op5_template_decontamination,
        op6_redirect_filter,
        op7_matroska_media,
        op8_temperature_mixture,
        op9_token_counts,
        op10_token_binary,
    )
}

def _oracles() -> dict[str, str]:
    from lantern.llm import decontaminate, mixing, secrets, urls

    return {
        "op3_secret_ledger": secrets.SQL,
        "op5_template_decontamination": decontaminate.SQL,
        "op6_redirect_filter": urls.SQL,
        "op8_temperature_mixture": mixing.SQL,
    }


ORACLE_SQL = _oracles()
