"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietgrove.llm.common import table
from quietgrove.scratch import Scratch

URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SPAM_HOSTS = r"(adult|casino|pills)"


def op1_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """Judge every page; the list holds the URLs of hosts that name themselves spam."""
    from quietgrove.llm.url_filter import UrlRule, filter_urls, url_host
    pages = table(spark, d, "pages").select("page_id", "url")
    listed = pages.where(url_host(F.col("url")).rlike(SPAM_HOSTS)).select("url")
    out = filter_urls(pages, listed, [UrlRule(*r) for r in URL_RULES])
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Measures and verdict of every document."""
    from quietgrove.llm.quality_rules import base_failed, judge, measures
    judged = judge(table(spark, d, "documents").select("doc_id", "text"))
    out = measures(judged)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", base_failed().alias("base_failed"),
                      (F.col("kept") & ~base_failed()).alias("kept"))


def op3_packing(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of 2,048 tokens."""
    import public_tokenizers
    from quietgrove.llm.packing import pack
    docs = table(spark, d, "documents").select("doc_id", "text")
    pieces = pack(docs, path or public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op4_bpe(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """Encode every document and decode its ids again."""
    import public_tokenizers
    from quietgrove.llm.bpe import decode, encode
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    coded = decode(encode(table(spark, d, "documents").select("doc_id", "text"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_sharding(spark: SparkSession, d: str) -> DataFrame:
    """Deal all documents into eight shards whose row counts differ by one at most."""
    from quietgrove.llm.sharding import shuffle_into_shards
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, d, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op6_html_text(spark: SparkSession, d: str) -> DataFrame:
    """The main text of every page."""
    from quietgrove.llm.html_text import extract
    return extract(table(spark, d, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", "n_chars")


def op7_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Predict the language of every document; a quarter of them is held out of the fit."""
    from quietgrove.llm.language_id import fit
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = fit(docs.where(~held_out))
    return model.predict(docs.select("doc_id", "text", held_out.alias("held_out"))).select(
        "doc_id", "held_out", "lang_pred", "score")


def op8_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    from quietgrove.llm.neighbours import search
    return search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    """Format every conversation, and one that is full of control strings, and read it back."""
    from quietgrove.llm.chat import conversation_digests, format_chats
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(
        *[F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"),
                   F.lit(role).alias("role"), F.lit(tricky).alias("text"))
          for i, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    chats = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(format_chats(chats.unionByName(extra)))


def op10_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    """Component of every document under links of 75 percent common shingles."""
    from quietgrove.llm.jaccard_join import jaccard_components
    return jaccard_components(table(spark, d, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Negatives of every vector whose id is divisible by 100, with a seventh of the labels moved."""
    from quietgrove.llm.hard_negatives import mine
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, d, "embeddings").withColumn("label", moved)
    return mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    """All vectors on their 32 first whitened components."""
    from quietgrove.llm.whitening import whiten
    return whiten(table(spark, d, "embeddings"), 32, scale=64, shift=1_000_000)


def op13_warc(spark: SparkSession, d: str) -> DataFrame:
    """All pages to archives, repeated payloads to revisits, and back."""
    from quietgrove.llm.warc import deduplicate, read_archives, resolved, write_pages
    found = Scratch(spark)
    with Scratch(spark) as captured, Scratch(spark) as kept:
        write_pages(table(spark, d, "pages").select("page_id", "url", "html"), captured.path)
        deduplicate(spark, captured.path, kept.path)
        records = found.save(read_archives(spark, kept.path).drop("http", "payload"))
    return resolved(records).withColumnRenamed("key", "page_id")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_quality_rules, op3_packing, op4_bpe,
                                  op5_sharding, op6_html_text, op7_language_id,
                                  op8_neighbours, op9_chat_formatting, op10_jaccard_join,
                                  op11_hard_negatives, op12_whitening, op13_warc)}
