"""Event-driven ingestion with Structured Streaming: files become messages, messages become elements, markdown, chunks and a registry.

A batch is decided against a versioned registry and writes partitions named by its number, so that a batch that runs again
changes nothing. A message that fails is delivered again, three times in all, then it is a dead letter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import elements as E
from ..operators import layout as L
from ..sources import files as S

MESSAGE = "message_id BIGINT, blob STRING, filename STRING, source_path STRING, last_modified STRING, correlation_id STRING, attempt INT"
REGISTRY = "document_id STRING, source_path STRING, hash STRING, version INT, status STRING, attempt INT, reason STRING"
ELEMENT = "element_type STRING, idx BIGINT, text STRING, level INT, list_ordered BOOLEAN, rows ARRAY<ARRAY<STRING>>"
#: Deliveries of a message, and batches after which the registry is folded into a snapshot.
DELIVERIES, COMPACT = 3, 10


def file_messages(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """One message for each new file of a folder, as JSON; the bytes are not read."""
    f = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    m = f.select(F.abs(F.xxhash64("path", "modificationTime")).alias("message_id"), F.col("path").alias("blob"), name.alias("filename"), F.col("path").alias("source_path"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("last_modified"), F.left(F.sha2(F.concat_ws("|", "path", "modificationTime"), 256), F.lit(16)).alias("correlation_id"), F.lit(1).alias("attempt"))
    # Folders by batch, not a file sink: its log would hide the messages that come back.
    write = lambda batch, n: batch.write.mode("overwrite").json(f"{out}/new-{n}")
    return m.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_messages(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Messages of a folder and of those below it, where failed ones come back."""
    return spark.readStream.schema(MESSAGE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).json(folder)


def sent(df: DataFrame, send: Callable[[list[dict]], None], tries: int = 3, delay: float = 0.4, size: int = 100) -> None:
    """Rows to a queue in small lots; a lot that fails is tried again after delay times 2 to the number of tries, then its task fails."""

    def deliver(rows):
        import time

        lot: list[dict] = []

        def flush():
            for n in range(tries):
                try:
                    return send(lot)
                except Exception:
                    if n == tries - 1:
                        raise
                    time.sleep(delay * 2**n)

        for r in rows:
            lot.append(r.asDict(recursive=True))
            if len(lot) == size:
                flush()
                lot = []
        if lot:
            flush()

    df.foreachPartition(deliver)


def once(events: DataFrame, time: str = "enqueued_at", key: str = "message_id", late: str = "7 days") -> DataFrame:
    """Messages once each within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, kind: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each kind in tumbling windows; events later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the partitions written below a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")) if fs.exists(p) else []


def registry_at(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """Last state of each document: the last snapshot and the batches after it, of those before the given number."""
    limit = float("inf") if before is None else before
    snaps = [n for n in _batches(spark, f"{folder}/snapshots") if n < limit]
    later = [n for n in _batches(spark, f"{folder}/registry") if (not snaps or n > snaps[-1]) and n < limit]
    paths = [f"{folder}/snapshots/batch={n}" for n in snaps[-1:]] + [f"{folder}/registry/batch={n}" for n in later]
    parts = [spark.read.schema(f"{REGISTRY}, batch BIGINT").parquet(x) for x in paths]
    rows = parts[0] if parts else spark.createDataFrame([], f"{REGISTRY}, batch BIGINT")
    for x in parts[1:]:
        rows = rows.unionByName(x)
    rest = [c for c in rows.columns if c != "document_id"]
    return rows.groupBy("document_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("document_id", "r.*")


def parsed(loaded: DataFrame, pdf: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """path and ELEMENT of files (path, filename, content) by format. pdf: files to elements with the column path; without it PDF files have none."""
    f = loaded.withColumn("format", S.file_format(F.col("content"), F.coalesce(S.mime(F.col("filename")), F.lit(""))))
    fields = [c.split(" ")[0] for c in ELEMENT.split(", ")]
    none = F.lit(None).cast("array<array<string>>")
    txt = E.sections(f.where("format = 'txt'").select("path", S.decoded(F.col("content")).alias("text")), "path").withColumn("rows", none)
    parts = [txt, S.docx_elements(f.where("format = 'docx'")).withColumn("rows", none)]
    if pdf:
        parts.append(pdf(f.where("format = 'pdf'")))
    out = None
    for x in parts:
        x = x.select("path", F.col("element_type"), F.col("idx").cast("bigint").alias("idx"), "text", F.col("level").cast("int").alias("level"), "list_ordered", "rows").select("path", *fields)
        out = x if out is None else out.unionByName(x)
    return out


def process(batch: DataFrame, number: int, folder: str, retry: str | None = None, pdf: Callable[[DataFrame], DataFrame] | None = None, size: int = 2000, overlap: int = 200) -> None:
    """One batch: read the files that its messages name, then write markdown, chunks, registry, rejects and dead letters.

    retry: folder of messages to which failed ones go back, with their next attempt. Only what is new or changed is
    written; of several messages of a document the last counts. The paths of a batch pass through the driver, their bytes
    do not.
    """
    spark = batch.sparkSession
    bad = F.col("blob").isNull() | F.col("filename").isNull() | F.col("source_path").isNull()

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    batch = batch.withColumn("attempt", F.coalesce("attempt", F.lit(1))) if "attempt" in batch.columns else batch.withColumn("attempt", F.lit(1))
    batch = batch.persist()
    write(batch.where(bad), "rejects")
    docs = batch.where(~bad).withColumn("document_id", T.document_id(F.col("filename")))
    docs = docs.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in docs.columns if c != "document_id"]), F.struct("attempt", "message_id")).alias("d")).select("document_id", "d.*").persist()
    paths = S.existing(spark, [r.blob for r in docs.select("blob").distinct().collect()])  # one batch of messages
    loaded = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    loaded = loaded.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    good, refused = S.accepted(loaded)
    elements = parsed(good, pdf).persist()
    text = L.rendered(elements, L.text_piece(), "plain", "path").join(L.rendered(elements, L.markdown_piece(), "markdown", "path"), "path").where("plain <> ''")
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")  # noqa: E731  # paths with and without scheme
    got = text.select(plain(F.col("path")).alias("p"), F.sha2("plain", 256).alias("hash"), "markdown")
    why = refused.select(plain(F.col("path")).alias("p"), "reason")
    j = docs.withColumn("p", plain(F.col("blob"))).join(got, "p", "left").join(why, "p", "left").join(loaded.select(plain(F.col("path")).alias("p"), F.lit(True).alias("found")), "p", "left")
    j = j.withColumn("reason", F.when(F.col("hash").isNotNull(), None).otherwise(F.coalesce("reason", F.when(F.col("found"), "unreadable").otherwise("not_found"))))
    known = registry_at(spark, folder, number).where("hash is not null").select("document_id", F.col("hash").alias("old"), F.col("version").alias("was"))
    j = j.join(known, "document_id", "left").persist()
    work = j.where("reason is null and (old is null or old <> hash)").withColumn("version", F.coalesce("was", F.lit(0)) + 1)
    failed = j.where("reason is not null")
    chunks = work.select("document_id", "version", F.posexplode(E.folded_chunks(F.split("markdown", r"\n\n"), size, overlap)).alias("k", "content"))
    write(chunks.select(T.chunk_id(F.col("document_id"), F.col("version"), F.col("k") + 1).alias("id"), "document_id", "version", (F.col("k") + 1).alias("chunk_index"), "content", F.sha2("content", 256).alias("content_hash")), "chunks")
    write(work.select("document_id", "version", T.blob_path(F.col("document_id"), F.concat(F.lit("v"), "version", F.lit(".md"))).alias("blob"), "markdown"), "markdown")
    state = lambda df, status: df.select("document_id", "source_path", "hash", F.col("version").cast("int"), F.lit(status).alias("status"), "attempt", "reason", F.lit(number).cast("bigint").alias("batch"))
    again = failed.where(F.col("attempt") < DELIVERIES)
    write(state(work, "processed").unionByName(state(failed.withColumn("version", F.col("was")).withColumn("hash", F.col("old")), "failed")), "registry")
    message = [c.strip().split(" ")[0] for c in MESSAGE.split(", ")]
    write(failed.where(F.col("attempt") >= DELIVERIES).select(*[c for c in message if c in failed.columns], "reason"), "dead_letters")
    if retry and not again.isEmpty():
        again.withColumn("attempt", F.col("attempt") + 1).select(*[c for c in message if c in again.columns]).write.mode("overwrite").json(f"{retry}/retry-{number}")
    if number and number % COMPACT == 0:
        registry_at(spark, folder, number + 1).write.mode("overwrite").parquet(f"{folder}/snapshots/batch={number}")
    for x in (batch, docs, elements, j):
        x.unpersist()


def start(messages: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Ingestion of all messages that are there now (also the backfill); run again for later ones and for those that come back."""
    return messages.writeStream.foreachBatch(lambda b, n: process(b, n, folder, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of each document's last version."""
    c = spark.read.parquet(f"{folder}/chunks")
    return c.join(registry_at(spark, folder).select("document_id", "version"), ["document_id", "version"], "left_semi")
