"""The registered queries with their production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow.llm import bit_sliced, bpe_automaton, differencing, merkle, oracles, packing, permutation_index, quality, quotation, simhash, site_style_tree, spelling, surrogates, toxicity
from timberflow.llm.common import held_out, small_batches, table, text_of

Query = Callable[[SparkSession, str], DataFrame]

#: Key of the test tables' surrogates; a user keeps an own one secret.
SURROGATE_KEY = "test tables"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(small_batches(spark), folder)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", text_of().alias("text"))
    model = toxicity.fit(documents, table(spark, folder, "labels"), parts=5, part=0)
    scored = documents.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), toxicity.scorer(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", text_of().alias("text"))
    model = quality.fit(documents, table(spark, folder, "labels"), parts=4, part=2)
    scored = documents.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), quality.scorer(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    groups = simhash.near_duplicates(documents)
    return groups.select("doc_id", simhash.hex_text(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_bpe_encode_decode")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = table(spark, folder, "documents").select("doc_id", bpe_automaton.codec(path)(F.col("text")).alias("c"))
    decoded = coded.select("doc_id", "c.ids", "c.decoded")
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_best_fit_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack_documents(documents, public_tokenizers.path("word_bpe_49k.json"))


@query("op10_pii_surrogates")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace(documents, SURROGATE_KEY)


@query("op6_bit_sliced_top_k")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return bit_sliced.search(table(spark, folder, "embeddings"), every=50, k=5)


@query("op7_permutation_index")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return permutation_index.search(table(spark, folder, "embeddings"), every=20, k=20)


@query("op4_html_extraction")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    extracted = site_style_tree.main_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return extracted.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op9_quotation_linking")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return quotation.link(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))


@query("op11_merkle_manifest", oracles.merkle())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tampered(table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


@query("op13_differencing_shards")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    assigned = differencing.assign(table(spark, folder, "documents").select("doc_id", "text"), shards=40)
    return assigned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op12_spelling_variants", oracles.spelling())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents").select("doc_id", "text"))
