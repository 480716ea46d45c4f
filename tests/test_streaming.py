"""Streaming ingestion on files: idempotent, versioned, with rejects; windows and late rows."""

from pyspark.sql import functions as F

from cvloom.sources import files
from cvloom.streaming import ingest


def file(tmp, name, data):
    folder = tmp / "files"
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def run(spark, tmp):
    """New files become messages, these are ingested; what fails comes back among the messages."""
    (tmp / "messages").mkdir(exist_ok=True)
    ingest.file_messages(spark, str(tmp / "files"), str(tmp / "messages"), str(tmp / "seen")).awaitTermination(120)
    ingest.start(ingest.read_messages(spark, str(tmp / "messages")), str(tmp / "out"), str(tmp / "check"), size=20, overlap=5, retry=str(tmp / "messages")).awaitTermination(120)


def state(spark, tmp):
    return {r.document_id: (r.version, r.status, r.attempt) for r in ingest.registry_at(spark, str(tmp / "out")).collect()}


def test_files_are_read_versioned_and_delivered_three_times(spark, tmp_path):
    file(tmp_path, "a v1.txt", "one\n\ntwo two two two two two.")
    file(tmp_path, "b.docx", b"no archive")
    run(spark, tmp_path)
    assert state(spark, tmp_path) == {"a": (1, "processed", 1), "b": (None, "failed", 1)}
    run(spark, tmp_path)
    assert state(spark, tmp_path)["b"] == (None, "failed", 2)
    file(tmp_path, "a v2.txt", "one\n\ntwo two two two two two.")  # the same content again
    run(spark, tmp_path)
    assert state(spark, tmp_path) == {"a": (1, "processed", 1), "b": (None, "failed", 3)}
    run(spark, tmp_path)
    assert state(spark, tmp_path)["b"] == (None, "failed", 3) and [(r.filename, r.reason) for r in spark.read.parquet(str(tmp_path / "out/dead_letters")).collect()] == [("b.docx", "unreadable")]
    file(tmp_path, "a v3.txt", "changed\n\ntext that is long enough.")
    run(spark, tmp_path)
    assert state(spark, tmp_path)["a"] == (2, "processed", 1)
    chunks = ingest.current_chunks(spark, str(tmp_path / "out")).where("document_id = 'a'").orderBy("chunk_index").collect()
    assert {r.version for r in chunks} == {2} and chunks[0].id == "a-v2-00001" and chunks[0].content.startswith("### changed")
    assert {r.blob for r in spark.read.parquet(str(tmp_path / "out/markdown")).collect()} == {"a/v1.md", "a/v2.md"}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    file(tmp_path, "a.txt", "text")
    batch = spark.createDataFrame([(1, str(tmp_path / "files/a.txt"), "a.txt", "p"), (2, None, "x", "p"), (3, str(tmp_path / "gone.txt"), "gone.txt", "p")], "message_id bigint, blob string, filename string, source_path string")
    for _ in range(2):
        ingest.process(batch, 0, str(tmp_path / "out"))
    assert state(spark, tmp_path) == {"a": (1, "processed", 1), "gone": (None, "failed", 1)} and spark.read.parquet(f"{tmp_path}/out/chunks").count() == 1 and spark.read.parquet(f"{tmp_path}/out/rejects").count() == 1


def test_snapshots_keep_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "COMPACT", 2)
    for n, text in enumerate(["one", "two", "three", "four"]):
        file(tmp_path, "a.txt", text)
        ingest.process(spark.createDataFrame([(n, str(tmp_path / "files/a.txt"), "a.txt", "p")], "message_id bigint, blob string, filename string, source_path string"), n, str(tmp_path / "out"))
    assert state(spark, tmp_path) == {"a": (4, "processed", 1)} and ingest._batches(spark, f"{tmp_path}/out/snapshots") == [2]


def test_queue_sink_tries_again(spark, tmp_path):
    mark = str(tmp_path / "failed")

    def send(lot):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        with open(f"{mark}-{lot[0]['id']}", "w") as out:
            out.write(str(len(lot)))

    ingest.sent(spark.range(5).coalesce(1), send, delay=0.01)
    assert (tmp_path / "failed-0").read_text() == "5"


def test_log_lines_are_followed(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for k, lines in enumerate(["all fine\nERROR one", "Traceback (most recent)\nok"]):
        (tmp_path / "logs" / f"{k}.log").write_text(lines)
        files.tailed(spark, str(tmp_path / "logs"), str(tmp_path / "errors"), str(tmp_path / "at")).awaitTermination(60)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "errors")).collect()) == ["ERROR one", "Traceback (most recent)"]


def test_windows_and_duplicates(spark, tmp_path, small):
    e = spark.read.parquet(f"{small}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    e.unionByName(e.limit(50)).coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))
    q = ingest.once(stream, "ts", "event_id", "400 days").writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == e.count()
    q = ingest.windowed_counts(stream, "ts", "event_type", "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == e.count() + 50
