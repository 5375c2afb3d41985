"""The ``opN_`` queries: each operator on its whole table, with production
parameters, and the digest columns that its contract asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, decontaminate, exact_topk, language_id, lexical_search, license_scan, line_dedup, mixing, periodic_runs,
               quotes, simhash, suffix_dedup, url_filter)

#: Queries of op10 and their results.
QUERY_EVERY, TOP = 50, 5
#: Results of each query of op12.
RANKED = 20
VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document or so, by a checksum of its id; a null id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", "n_blocks", "n_partners", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")).select(
        "conv_id", "turn", "role", "n_quoted", "n_linked", "reply_to", "thread", "position", "clean_text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url", "html")
    rules = url_filter.rule_table(spark, url_filter.RULES)
    return url_filter.filter_urls(pages.select("page_id", "url"), url_filter.page_edges(pages), rules).select(
        "page_id", "host", "path", "rule", "verdict")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), language_id.predict(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"),
                        F.col("p.distance").alias("distance"), F.col("p.rejected").alias("rejected"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_component(_table(spark, sf_dir, "documents", "doc_id", "text"))


def vocabulary(spark: SparkSession) -> tuple[list[bytes], str]:
    """Tokens by rank and the pre-token pattern of the public vocabulary."""
    import public_tokenizers

    return byte_bpe.read_vocabulary(spark, public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def token_digests(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    ids = docs.select("doc_id", byte_bpe.encode(F.col("text"), tokens, pattern).alias("ids"))
    both = ids.withColumn("bytes", byte_bpe.decode(F.col("ids"), tokens))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2(F.col("bytes"), 256).alias("decoded_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents", "doc_id", "text"), *vocabulary(spark))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    hits = decontaminate.with_hits(docs, _table(spark, sf_dir, "benchmark", "item_id", "text")).select("doc_id", "hits")
    return hits.select("doc_id", "hits.n_words", F.size("hits.words").cast("long").alias("n_hit"),
                       F.size("hits.items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
                       (F.size("hits.words") > 0).alias("contaminated"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return exact_topk.search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), TOP)


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixing.mix_digest(mix).drop("source")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                 _table(spark, sf_dir, "benchmark", "item_id", "text"), RANKED)


def with_planted_run(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts, where a checksum of the id says so, repeat with period p from word a on."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    # the words are a column of their own, or each would be split out anew
    marked = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string"))).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    marked = marked.withColumns({"n": F.when(F.size("w") > 0, F.size("w").cast("bigint")), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.col("g") % F.col("n"))
    marked = marked.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    planted = F.transform("w", lambda w, i: F.when(i >= F.col("a"), at(i)).otherwise(w))
    return marked.withColumn("text", F.when(F.col("n").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text"))).select(*docs.columns)


def run_digests(done: DataFrame) -> DataFrame:
    """Of ``collapse_runs``: the number of runs, the best, and digests. Exponents are compared by
    cross products, exactly: lengths and periods stay below 2^31."""
    better = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    # runs come by start, then period, so the first of equal ones stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    done = done.withColumn("best", best)
    return done.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return run_digests(periodic_runs.collapse_runs(with_planted_run(docs)))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quotes": quotes.oracle_sql(), "op4_url_filter": url_filter.oracle_sql(),
            "op8_license_scan": license_scan.oracle_sql(), "op9_decontaminate": decontaminate.oracle_sql(),
            "op10_exact_topk": exact_topk.oracle_sql(QUERY_EVERY, TOP),
            "op12_lexical_search": lexical_search.oracle_sql(RANKED)}
