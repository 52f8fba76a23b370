"""One query per operator over its whole table, each with check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import (bpe_chunks, checks, decontaminate, divergence, exact_dedup, html_blocks, license_rules, quality_net, reply_trees,
                         shards, sketch_join, spelling, token_counts, url_trie)
from attesta.llm.words import whole

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
DIGEST_TEXT = r"\### Assistant: </turn> ok"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = BYTE_VOCABULARY) -> str:
    """Definition of a public tokenizer, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def unigrams(name: str = PIECES) -> list[tuple[str, float]]:
    """Pieces and scores of a public vocabulary, read on the driver."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@query("op1_html_blocks")
def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extract(pages, html_blocks.fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), unigrams())


@query("op3_quality_net")
def op3_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; held-out rows are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_net.score(docs, quality_net.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_net.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_reply_trees", checks.REPLY_TREES)
def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the template's own marks, formatted and read back."""
    extra = spark.sql(
        "SELECT -7L AS conv_id, turn, role, text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role) "
        "CROSS JOIN (SELECT :mark AS text)", args={"mark": DIGEST_TEXT})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    nodes = reply_trees.linear_nodes(rows)
    done = reply_trees.format_paths(nodes, reply_trees.ranked_paths(nodes))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        done.withColumns({"turns": reply_trees.read_back(F.col("formatted")),
                          "loss": reply_trees.loss_text(F.col("formatted"), F.col("loss_spans"))})
        .select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
                F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                F.length("formatted").cast("long").alias("formatted_chars"))
    )


@query("op5_decontaminate", checks.DECONTAMINATE)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document words inside benchmark windows of ten words."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op6_bpe_chunks")
def op6_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    definition = vocabulary()
    encoded = bpe_chunks.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), definition)
    decoded = bpe_chunks.decode(encoded.select("doc_id", "n_tokens", "ids"), definition)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_exact_dedup", checks.EXACT_DEDUP)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op8_shards")
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shuffled shards."""
    done = shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "size", F.crc32(whole("text").cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_license_rules")
def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and rule labels of every document."""
    found = license_rules.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base_starts", lambda b: b["start"])
    return found.select(
        "doc_id", "n_words", F.size("base_starts").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


@query("op10_sketch_join", checks.SKETCH_JOIN)
def op10_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count and the component of its links."""
    return sketch_join.near_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: host, path and verdict of the entries that ``op11`` judges by
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op11_url_trie", checks.URL_TRIE)
def op11_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the longest rule."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_trie.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op12_spelling_variants", checks.SPELLING)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of the documents with their near words, forms and roots; one run in 199 is misspelt first."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), every=199)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_source_divergence", checks.DIVERGENCE)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, and the terms it uses more than its language does."""
    return divergence.audit(table(spark, sf_dir, "documents"))
