"""The queries of the llm operators and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, lexical_search
from .context_mixing import score_texts
from .decision_list import quality_rules
from .decontaminate import contaminated
from .html_extract import extract_main_text
from .jaccard_join import jaccard_components
from .language_id import identify_documents, identify_pages
from .packing import packed
from .spark_util import read_table
from .suffix_dedup import removal_digest
from .tiered_packing import tiered
from .token_counts import section_tokens


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' log10 probabilities, learned from those with crc32(doc_id) mod 10 other than 0."""
    return score_texts(read_table(spark, sf_dir, "documents"))


def documents_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, which have neither markup nor address: text, declared language and source fused, as in the pipeline."""
    return identify_documents(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: text, markup language, address suffix and host fused; trigrams learned from documents."""
    return identify_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations that no other one continues, rendered."""
    return chat.rendered(read_table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the base rule and the decision list learned from labels."""
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by their hosts' style trees."""
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    out = packed(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of all documents, each document encoded once; boundary tokens by majority."""
    import public_tokenizers

    return section_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingle sets of all documents, linked at a Jaccard similarity of 0.9 or more."""
    return jaccard_components(read_table(spark, sf_dir, "documents"), ngram=3, num=90, den=100)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents covered by a 100-byte string that also starts earlier."""
    return removal_digest(read_table(spark, sf_dir, "documents"), min_length=100)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items; a row for each leak."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of all documents."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"), least=30, share=80, most=2000)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's 10 best of all documents."""
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def op13_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in full windows of 2048 tokens and lower powers of two."""
    return tiered(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_language_id": op2_language_id,
        "documents_language_id": documents_language_id,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_quality_rules": op4_quality_rules,
        "op5_html_extraction": op5_html_extraction,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_token_counts": op7_token_counts,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_collocations": op11_collocations,
        "op12_ranked_search": op12_ranked_search,
        "op13_tiered_packing": op13_tiered_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": chat.ORACLE, "op11_collocations": collocations.ORACLE, "op12_ranked_search": lexical_search.ORACLE}
