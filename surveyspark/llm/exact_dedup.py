"""Exact dedup by a stateful stream over content digests.

An arrivals table (id, SHA-256 of the text, locator of the content) is streamed
through a keyed aggregation whose state lives in RocksDB and never expires: one
entry per digest with the id that stays, its locator and the number of arrivals.
Only ids and digests pass through the state; texts are read again for digests
that were hit, where whole texts are compared. Should different texts ever share
a digest, those groups are grouped again by the text itself.

Everything runs in the JVM. Pre-aggregation happens before each shuffle, so a
text that makes up a third of the corpus sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_path, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Entries are small: no preallocated files, and only changes go to the shared folder.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

SALTS = 32


def sha256(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def absorb(arrivals_path: str, schema, state_path: str, spark: SparkSession) -> DataFrame:
    """Feed all arrivals not seen yet to the state under ``state_path``; return the state.

    The stream remembers which files it has read: a later call with more files in
    the same folder goes on from the kept state. One row per digest: digest,
    keep_id (largest id), locator (of that id), group_size.
    """
    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        stream = spark.readStream.schema(schema).parquet(arrivals_path)
        keyed = stream.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.max_by("locator", F.coalesce("doc_id", F.lit(-(2**63)))).alias("locator"),
        )
        query = (
            keyed.writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", state_path).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(state_path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    kept = [F.col(f"value.`{f.name}`") for f in state.schema["value"].dataType.fields]
    return state.select(
        F.col("key.digest").alias("digest"), kept[0].alias("keep_id"),
        kept[1].alias("group_size"), kept[2].alias("locator"),
    )


def exact_duplicates(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    Of equal texts the largest doc_id stays. A null text equals the empty text.
    A null doc_id ranks below every other; a group of null ids only has a null
    keep_id and keeps its rows. Rows that repeat the kept id and text are all
    marked kept. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    plain = documents(docs)
    path = shared_path(spark, "arrivals")
    plain.select(
        "doc_id", digest(F.col("text")).alias("digest"), F.input_file_name().alias("locator")
    ).write.parquet(path)
    arrivals = spark.read.parquet(path)
    if arrivals.isEmpty():  # a stream without input leaves no state to read
        return arrivals.select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), "digest",
        )
    state = written(absorb(path, arrivals.schema, shared_path(spark, "state"), spark), "digests")

    # A hot text's copies are dealt over SALTS tasks; each sends on two texts at most.
    salted = state.filter("group_size > 1").select("digest").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    texts = plain.withColumns({
        "digest": digest(F.col("text")), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"),
    })
    extremes = texts.join(salted, ["digest", "salt"]).groupBy("digest", "salt").agg(
        F.min("text").alias("low"), F.max("text").alias("high")
    )
    # A group whose smallest and largest text are equal holds one text only.
    disputed = written(
        extremes.groupBy("digest").agg((F.min("low") != F.max("high")).alias("mixed"))
        .filter("mixed").select("digest"),
        "disputed",
    )
    columns = (
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest",
    )
    found = arrivals.drop("locator").join(state.drop("locator"), "digest")
    if disputed.isEmpty():
        return found.select(*columns)
    settled = found.join(disputed, "digest", "left_anti").select(*columns)
    mixed = plain.withColumn("digest", digest(F.col("text"))).join(disputed, "digest")
    by_text = mixed.groupBy("text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return settled.unionByName(mixed.join(by_text, "text").select(*columns))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is named by its id, null included, and the digest of its text; of rows that
    repeat both one stays.
    """
    found = exact_duplicates(docs).filter("kept").groupBy(
        F.col("doc_id").alias("_keep"), F.col("digest").alias("_digest")
    ).agg(F.count(F.lit(1)).alias("_rows"))
    kept = written(found, "kept")

    def named(rows: DataFrame, names: DataFrame, how: str) -> DataFrame:
        own = sha256(F.coalesce(rows["text"], F.lit("")))
        return rows.join(names, rows["doc_id"].eqNullSafe(names["_keep"]) & (own == names["_digest"]), how)

    rows = named(docs, kept.drop("_rows"), "left_semi")
    again = kept.filter("_rows > 1").drop("_rows")
    if again.isEmpty():
        return rows
    once = named(rows, again, "left_semi")
    spare = "_text" + "_" * max(map(len, once.columns))  # longer than any column's name
    once = once.withColumn(spare, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", spare]).drop(spare)
    return named(rows, again, "left_anti").unionByName(once)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
