"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cotrain, decontaminate, fim, langid, lm_score, ogg, pii, simhash, substrings, warc, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["disguised"])

    def of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(of, pii.KINDS),
        F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised"),
    )


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = ogg.decode_media(ogg.encode_texts(table(spark, sf_dir, "documents")))
    facts = [F.concat(F.lit(f"{x.split()[0]}="), F.col(f"facts.{x.split()[0]}").cast("string")) for x in ogg.FACTS.split(", ")]
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", *facts).alias("feature"),
    )


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages"))
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return read.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), lm_score.target_ids(table(spark, sf_dir, "labels")))


def op5_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), "byte_bpe_50k.json").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars")


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, budget=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    chats = chat.format_chats(rows.unionByName(own)).withColumn("turns", chat.read_turns(F.col("formatted")))
    masked = chat.under_mask(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumn("masked", masked).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_langid_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out), "piece_bpe_32k.model")
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model).select("doc_id", "quality_score", (F.col("quality_score") >= cotrain.THRESHOLD).alias("keep"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that is no long is null."""
    made = whiten.report(table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = substrings.distinct_texts(docs)
    made = substrings.without_repeats(texts).select("tid", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return substrings.by_document(docs, texts, made)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_deobfuscation": op1_pii_deobfuscation,
    "op2_ogg_media": op2_ogg_media,
    "op3_warc_chunks": op3_warc_chunks,
    "op4_cross_entropy_difference": op4_cross_entropy_difference,
    "op5_bpe_stream": op5_bpe_stream,
    "op6_simhash_trie": op6_simhash_trie,
    "op7_chat_format": op7_chat_format,
    "op8_langid_pieces": op8_langid_pieces,
    "op9_quality_cotraining": op9_quality_cotraining,
    "op10_spaced_seeds": op10_spaced_seeds,
    "op11_whitening": op11_whitening,
    "op12_substring_automata": op12_substring_automata,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(floor(v / {0}) AS BIGINT) % 32, 1)"

ORACLE_SQL: dict[str, str] = {
    "op3_warc_chunks": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), g AS (SELECT html, max(page_id) AS first FROM p GROUP BY html),
d AS (SELECT html, string_agg({_DIGIT.format(32768)} || {_DIGIT.format(1024)} || {_DIGIT.format(32)} || {_DIGIT.format(1)}, '' ORDER BY i) AS digest
    FROM (SELECT html, i, CAST('0x' || substr(sha1(html), 1 + 5 * i, 5) AS BIGINT) AS v FROM (SELECT html, unnest(range(8)) AS i FROM g)) GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to
FROM p JOIN g USING (html) JOIN d USING (html)
""",
    "op7_chat_format": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 7 + CASE WHEN before = role THEN 0 ELSE length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 4 END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
""",
    "op4_cross_entropy_difference": lm_score.SQL,
    "op12_substring_automata": substrings.SQL,
    "op13_fill_in_middle": fim.SQL,
}
