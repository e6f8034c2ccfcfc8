"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.llm import (convrepair, decontamination, langid, linededup, lm, ngramjoin, onebit, packing, periodic, pii,
                          reputation, sharding, sql, toxicity)
from linkrisk.llm.base import read_table

TOKENIZER = "word_bpe_49k.json"
RULES = [reputation.Rule("allow", "org", "/"), reputation.Rule("block", "example.org", "/es/"),
         reputation.Rule("block", "example.org", "/en/1"), reputation.Rule("allow", "com", "/fr/"),
         reputation.Rule("block", "com", "/de/")]


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under the whole corpus' counts."""
    return lm.score_documents(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: lines dropped, and digest of what stays."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs, dropped_col="dropped")
    return out.select("doc_id", F.col("dropped").cast("long").alias("dropped"), F.octet_length("text").cast("long").alias("kept_bytes"),
                      F.md5("text").alias("kept_md5"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; a page is bad when its document is labelled quality 0."""
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("url_key"), (F.col("quality") == 0).cast("int").alias("bad"))
    return reputation.judge_urls(read_table(spark, sf_dir, "pages"), labels, RULES)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all documents."""
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), 2048).drop("ids")


def held_out(doc_id=None):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id or "doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
                      *[F.col("clauses")[i].alias(x.replace("+", "_targeted")) for i, x in enumerate(toxicity.LABELS)])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) match within the error budget."""
    return decontamination.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return ngramjoin.jaccard_components(read_table(spark, sf_dir, "documents"), 3, 90)


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 8, by bytes."""
    out = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    out = pii.find_pii(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind_no"] == k)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
                      F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      pii.span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return onebit.neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, after the contract's planting of periods."""
    docs = periodic.with_planted_periods(read_table(spark, sf_dir, "documents"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.col("strongest")
    return periodic.periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    profiles = langid.learn_profiles(docs.filter(~held), F.col("lang").cast("string"), F.col("text").cast("string"))
    return langid.identify(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after the contract's damage, and its cheapest repair."""
    source = read_table(spark, sf_dir, "conversations")
    done = convrepair.repair(convrepair.damaged(source))
    ids = source.select("conv_id").distinct()

    def add(out: DataFrame, more: DataFrame) -> DataFrame:
        more = more.withColumnRenamed("conv_id", "_id")
        return out.join(more, out["conv_id"].eqNullSafe(more["_id"]), "left").drop("_id")

    out = add(add(add(ids, done.report), convrepair.audits(done)), convrepair.sequence_digests(convrepair.repaired_rows(done)))
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


OPS = [op1_lm_score, op2_line_dedup, op3_url_reputation, op4_pack, op5_toxicity, op6_decontaminate, op7_ngram_jaccard,
       op8_shard, op9_pii, op10_nearest, op11_periodic_runs, op12_language, op13_conversation_repair, pipeline]


def register(queries: dict, oracles: dict) -> None:
    queries.update({f.__name__: f for f in OPS})
    oracles.update(SQL)


SQL: dict[str, str] = {"op11_periodic_runs": sql.periodic_sql(), "op12_language": sql.language_sql(langid.SIZE),
                       "op13_conversation_repair": sql.conversation_sql()}
