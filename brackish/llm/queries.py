"""Queries of the numbered operators over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, count_trie, cws, hash_tree, html_mincut, ordinal, packing, pii, quality, simhash, suffix_array, toxicity
from .common import table


#: The key of the registered query; a real corpus passes its own.
PII_KEY = "public demonstration key"
SHARDS = 40


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file; a cluster ships it with the package of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and failure bits of every whole text, and what the two policies keep; null texts count as empty, repeated rows stay."""
    rows = quality.ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.POLICIES["v2"]).alias("kept"),
        quality.passes(quality.POLICIES["v1"]).alias("kept_v1"), "fail_bits",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy keeps, and would keep without each of its rules, from counts of the ledger's bit patterns."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents"), ["doc_id"]))


def op2_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 for low quality, 1 for good quality that is toxic, 2 for good quality that is not."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rating = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    model = ordinal.learn(docs, labels, rating, allowed=~toxicity.held_out("doc_id"))
    graded = ordinal.grade(docs, model, ["doc_id"], least=1)
    return graded.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "expected_grade", "tail",
        (F.col("tail") >= ordinal.TAIL).alias("kept"),
    )


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without its repeated passages of 200 bytes; null texts are empty, repeated rows are copies."""
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text by a model of the labels that are not held out; null and empty texts are scored as empty ones."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with pseudonyms for its private values; null stays null, equal values stay equal."""
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY, count="n_replaced")
    return found.select("doc_id", "text", "n_replaced")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page; null pages and pages without content have an empty text."""
    return html_mincut.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op7_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted samples of every whole text and of its edited one; null texts are empty, equal texts have equal samples."""
    found = cws.compared(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", cws.as_text(F.col("samples")).alias("fingerprint"),
        cws.as_text(F.col("edited_samples")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without a word share fingerprint zero."""
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text's ids and of what they decode to; null texts are empty."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary(), ["doc_id"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document; null texts are a piece of one token."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op11_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards by the law `key`: id and number of shards decide."""
    return hash_tree.sharded(table(spark, sf_dir, "documents"), SHARDS)


def op12_count_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its form and root; null texts have no words."""
    return count_trie.variants(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenisations of every whole text aligned, with corpus-wide counts of their links; null texts have zeros."""
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


LLM_QUERIES = {"op1_quality_ledger": op1_quality_ledger, "quality_ablation": quality_ablation, "op2_ordinal": op2_ordinal, "op3_suffix_array": op3_suffix_array, "op4_toxicity": op4_toxicity, "op5_pii": op5_pii, "op6_html": op6_html, "op7_weighted_samples": op7_weighted_samples, "op8_simhash": op8_simhash, "op9_bpe": op9_bpe, "op10_packing": op10_packing, "op11_hash_tree": op11_hash_tree, "op12_count_trie": op12_count_trie, "op13_alignment": op13_alignment}
LLM_ORACLE: dict[str, str] = {"op1_quality_ledger": quality.ORACLE, "quality_ablation": quality.ABLATION_ORACLE}
