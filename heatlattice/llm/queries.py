"""The queries of the training-data operators and, where SQL can state them, their DuckDB counterparts."""

from __future__ import annotations

from . import alignment, bpe, chat, embeddings, jaccard, langid, lattice, packing, quality, squares, suffix, toxicity, variants


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_dedup(spark, sf_dir):
    return suffix.deduplicate(table(spark, sf_dir, "documents"))


def op2_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_embedding_join(spark, sf_dir):
    return embeddings.link_components(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), with_spans=True)


def op7_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_chat_format(spark, sf_dir):
    return chat.digests(chat.planted(table(spark, sf_dir, "conversations")))


def op10_lattice_score(spark, sf_dir):
    return lattice.score(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_token_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_best_fit(spark, sf_dir):
    return squares.pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op13_spelling_variants(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_pack, op3_language, op4_embedding_join, op5_quality_rules, op6_toxicity, op7_jaccard_join, op8_byte_bpe, op9_chat_format, op10_lattice_score, op11_token_alignment, op12_best_fit, op13_spelling_variants)}

ORACLE = {
    "op4_embedding_join": embeddings.ORACLE,
    "op5_quality_rules": quality.oracle(),
    "op7_jaccard_join": jaccard.oracle(),
    "op9_chat_format": chat.ORACLE,
    "op13_spelling_variants": variants.oracle(),
}
