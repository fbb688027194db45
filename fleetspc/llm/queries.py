"""The operators as queries over the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspc.llm import (
    chat, divergence, fingerprints, languages, line_dedup, mixing, near_copies, packing, prefix_trie, resharding, secrets,
    token_shards, vectors,
)
from fleetspc.sources.workspace import new_path

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    """Lines per document, those dropped as repeated or near, and links to different near lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = line_dedup.with_repeated_lines(docs)
    dropped = F.transform(F.filter("line_marks", lambda m: m["dropped"]), lambda m: m["line_no"])
    links = F.aggregate("line_marks", F.lit(0).cast("long"), lambda total, m: total + m["n_links"])
    return marked.select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(links, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.array_join(dropped, ","), F.lit("")).alias("dropped"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, new_path(spark, "secrets-ledger"))
    base = [rule.kind for rule in secrets.BASE_RULES]

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    basic = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id", *[number(kind) for kind in base],
        F.sha2(_joined(basic), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def op3_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    made = chat.format_conversations(turns.unionByName(planted))
    read = made.withColumn("turns", chat.read_turns(F.col("formatted")))
    read = read.withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    said_by_turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said_by_turn, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op5_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_shards(spark, sf_dir):
    """Every sequence as it is read back from its shard."""
    folder = new_path(spark, "token-shards")
    token_shards.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, tokenizer_path())
    return token_shards.read_slots(spark, folder, checksum=True)


def op7_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_vectors(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = languages.learn_profiles(docs.where(~languages.held_out()))
    predicted = languages.predict_languages(docs, profiles)
    return predicted.select("doc_id", languages.held_out().alias("held_out"), "lang_pred", "score")


def op10_near_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_copies.near_copies(docs).select("doc_id", "class_id", "kept")


def op11_prefix_trie(spark, sf_dir):
    """Conversations in groups of twenty share up to three first turns with the first of the group."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rebuilt = prefix_trie.rebuild(
        prefix_trie.own_turns(turns), lambda c: c - c % 20, lambda c: F.crc32(c.cast("string").cast("binary")) % 4, 3
    )
    return prefix_trie.trie(rebuilt)


# The query's documents stand in this many shards before they move to SHARDS.
OLD_SHARDS, SHARDS = 6, 8


def op12_resharding(spark, sf_dir):
    """Documents of a layout by id, moved to shards of equal bytes and read back from their files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_path(spark, "sharded")
    resharding.lay_out(docs, folder, OLD_SHARDS)
    version = resharding.reshard(spark, folder, 0, SHARDS, docs.schema)
    placed = resharding.read_shards(spark, folder, version, docs.schema)
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    return placed.select(
        F.col("doc.doc_id").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_secret_scan, op3_chat_format, op4_pack, op5_mixture, op6_token_shards,
        op7_fingerprints, op8_near_vectors, op9_language, op10_near_copies, op11_prefix_trie,
        op12_resharding, op13_source_divergence,
    )
}
