"""The corpus operators applied to the test tables, with production parameters.

Each query takes whole tables and returns the full result; the digest columns are
derived here from the operators' outputs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm import audio, bpe, chat, lm, mixing, quality, simhash, sql, tokenfile, urls, warc
from stackroom.shared import materialize, small_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.col("text")
    stored = docs.select(
        "doc_id",
        F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"),
        audio.wav_column(audio.padded_payload(text)).alias("media"),
    )
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    got = audio.audio_features(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return got.select(
        "doc_id",
        "n_bytes",
        F.col("pcm_bytes").alias("payload_bytes"),
        F.col("pcm_sha256").alias("payload_sha256"),
        F.col("pcm_tail_crc32").alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(";", F.col("frames").cast("string"), audio.patch_digest(F.col("tensors"), F.col("segments"))).alias("feature"),
    )


#: Rules of the query: hosts with their subdomains and the start of paths.
HOST_RULES = [
    urls.prefix_rule("block", "com", "/en/"),
    urls.prefix_rule("allow", "example.com", "/en/7"),
    urls.prefix_rule("allow", "net", "/de/"),
    urls.prefix_rule("block", "example.net", "/de/8"),
    urls.prefix_rule("block", "org", "/es/"),
]
#: Patterns that decide where no host rule fits.
PATTERN_RULES = [
    urls.Rule("||cheap-pills.", "block"),
    urls.Rule("||spam-farm.", "block"),
    urls.Rule("||casino*.", "block"),
    urls.Rule("/wp-login.php|", "block"),
    urls.Rule("||ads^", "block"),
    urls.Rule("||tracker^", "block"),
]


def op2_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), [*HOST_RULES, *PATTERN_RULES])


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = small_table(
        spark,
        [{"conv_id": -7, "turn": i, "role": role, "text": said} for i, role in enumerate(("user", "assistant"))],
        "conv_id bigint, turn bigint, role string, text string",
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    got = chat.read_conversations(chat.format_examples(turns))
    said_by = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("replies", "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_by, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )


WORD_BPE, BYTE_BPE, LM_BPE = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(WORD_BPE), "rb") as file:
        spec = file.read()
    manifest = tokenfile.write_token_files(_table(spark, sf_dir, "documents"), spec, end_id=1)
    return tokenfile.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """What op6 and the pipeline's last stage return."""
    ranks = bpe.load_ranks(public_tokenizers.path(BYTE_BPE))
    tokens = bpe.token_table(docs.sparkSession, ranks)
    return bpe.encode_bpe(docs, ranks, public_tokenizers.PATTERN, tokens=tokens).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rates and copies; the texts are read for the fit's sample and once for the posteriors."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = mixing.fit_domains(docs, labels)
    table = materialize(mixing.add_posteriors(docs, model).select("doc_id", "n_tokens", "posteriors"), "posteriors")
    steps, gap = mixing.fit_rates(table)
    got = mixing.with_rates(table, steps)
    shares = [F.get("posteriors", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)]
    return got.select("doc_id", "n_tokens", *shares, "rate", "copies", F.lit(gap).alias("target_gap"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path(LM_BPE))
    got = lm.score_texts(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords")


def op9_quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality.rule_statistics(_table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit_quality(stats, _table(spark, sf_dir, "labels"))
    return quality.judge(stats, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op10_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_audio_features,
        op2_url_verdicts,
        op3_simhash_groups,
        op4_chat_prefix_targets,
        op5_token_files,
        op6_byte_bpe,
        op7_mixing_rates,
        op8_lm_scores,
        op9_quality_verdicts,
        op10_warc_records,
    )
}
ORACLES = {"op2_url_verdicts": sql.URL_VERDICTS, "op4_chat_prefix_targets": sql.CHAT, "op10_warc_records": sql.WARC}
