"""Exact deduplication by a stateful stream (operator 9); DataFrame functions only.

A first stream reads what is new, normalises each text and hashes it, once, and writes identifier, place (file and row)
and digest. A second, stateful stream over these keeps, for each digest, the smallest identifier, where that row's text
is, and how many rows had it. The state has no expiry and lives on disk (RocksDB, backed up to the checkpoint in shared
storage). Batches append to a ledger; a batch that is replayed overwrites its own folder. Rows are then held against
the ledger: where a digest was seen before, the whole normalised texts are compared byte for byte, and digests under
which texts differ are grouped again by their texts.

A digest may hold a third of all rows. The state takes partial sums; heavy digests meet their rows by broadcast (there
can't be many, see spread_join); and the comparison deals the rows of a digest out over as many places as they need,
with a copy of the first text in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.streaming.flows import place, put_batches

from .common import SPACES, attach, materialise, missing_ids, shared_path, spread_join

#: Rows of a digest that are compared with the first text in one place.
TOGETHER = 256
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normal(text: Column) -> Column:
    """Every run of U+0020 and U+0009 to U+000D as one space; null as empty. Other white space stays."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _place() -> Column:
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))


def _first() -> Column:
    """The row that stays comes first: smallest id, null ids last, then by place."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")


DIGESTS = "doc_id long, locator string, digest string"


def ingest(
    spark: SparkSession, source: str, store: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Stream what is new under ``source`` (Parquet) into the keyed state kept under ``store``.

    Returns the digests (doc_id, locator, digest) of all rows so far and the ledger (digest, first, n). Call again with the
    same ``store`` as files arrive: only new files are read, and the state carries on. ``files_per_batch`` bounds a
    micro-batch.
    """
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(spark.read.parquet(source).schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        rows = reader.parquet(place(source)).select(F.col(id_col).cast("long").alias("doc_id"), _place().alias("locator"), digest(normal(F.col(text_col))).alias("digest"))
        _drain(rows, f"{store}/digests", f"{store}/digests-log", "append")
        reader = spark.readStream.schema(DIGESTS).option("recursiveFileLookup", "true")
        state = reader.parquet(f"{store}/digests").groupBy("digest").agg(F.min(_first()).alias("first"), F.count("*").alias("n"))
        _drain(state, f"{store}/ledger", f"{store}/ledger-log", "update")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    entries = spark.read.schema(state.schema).option("recursiveFileLookup", "true").parquet(f"{store}/ledger")
    # A digest's count only grows and its first row only moves forward.
    ledger = entries.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))
    return spark.read.schema(DIGESTS).option("recursiveFileLookup", "true").parquet(f"{store}/digests"), ledger


def _drain(stream: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    """All that is there, into folders named by the batch."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.foreachBatch(put_batches(out)).start().awaitTermination()


def exact_duplicates(
    spark: SparkSession, source: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None, store: str | None = None
) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, digest) for each row under ``source``.

    Equal: identical after normal(). The row with the smallest id stays; of rows that repeat that id, the first by
    file and row. Null text counts as empty; null ids come after all others (keep_id is null only if all are). An
    empty table gives no rows; extra columns are ignored. A digest may collide: texts decide. ``store``: see ingest().
    """
    source = source.rstrip("/")
    if spark.read.parquet(source).isEmpty():  # a stream over no rows writes no ledger
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, digest string")
    rows, ledger = ingest(spark, source, store or shared_path(spark, "exact"), id_col, text_col, digest, files_per_batch)
    total = rows.count()
    held = materialise(spread_join(rows, materialise(ledger, "ledger"), "digest", "n", total), "held")
    decided = held.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("first.locator")).alias("kept"), "digest")
    # Full bytes are compared for every row of a digest that came more than once.
    hits = held.where("n > 1").select("locator", "doc_id", "digest", "n", F.col("first.locator").alias("first_locator"))
    texts = attach(spark.read.parquet(source).select(_place().alias("locator"), F.col(text_col).alias("_text")), hits, "locator")
    texts = materialise(texts.withColumn("norm", normal(F.col("_text"))).drop("_text"), "hit-texts")
    places = F.ceil(F.col("n") / TOGETHER)
    first = texts.where("locator = first_locator").select("digest", F.col("norm").alias("first_norm"), F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("at"))
    dealt = texts.withColumn("at", F.pmod(F.xxhash64("locator"), places))
    differ = materialise(dealt.join(first, ["digest", "at"]).where(F.col("norm") != F.col("first_norm")).select("digest").distinct(), "collisions")
    if differ.isEmpty():
        return decided
    again = texts.join(differ, "digest", "left_semi").select("digest", "norm", "doc_id", "locator")
    groups = materialise(again.groupBy("digest", "norm").agg(F.min(_first()).alias("first"), F.count("*").alias("n")), "text-groups")
    apart = spread_join(again, groups, ["digest", "norm"], "n", total)
    apart = apart.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("first.locator")).alias("kept"), "digest")
    return missing_ids(decided, differ, "digest").select(*apart.columns).unionByName(apart)


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every row of documents with the row that stays for it."""
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
