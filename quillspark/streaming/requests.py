"""Requests from a stream: at least once, each id answered once, bounded retries, dead letters.

Requests and retries are two folders of JSON lines that one query reads.  What arrives is remembered by id and attempt
in the query's state store, so an id that is delivered again, in the same batch or any later one, is dropped; state
older than ``remember`` is forgotten.  Transient failures go back as lines of the retry folder with the next
attempt's number, up to ``attempts``; then they are answered as errors.  Every output of a batch is written under
the batch's number in ``overwrite`` mode, before the batch is committed: a batch that runs again after a crash has the same
rows and the same state, and replaces what it wrote; lines that it had sent to be retried, and that were read in
the meantime, come again and are dropped.

Edge cases: unreadable lines, and those without id or url, go to the dead letters and are answered by nobody; an id whose
first delivery was unreadable is not remembered; an empty folder gives empty outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "id string, url string, attempt int"
RESULT = "id string, status string, code string, retryable boolean, body string, attempts int"
DEAD = "value string, error string"


def parse_requests(lines: DataFrame) -> DataFrame:
    """``value`` lines to ``id, url, attempt, error``: an object with both non-empty, else a code; the first attempt unless it says otherwise."""
    row = F.from_json("value", REQUEST)
    parsed = lines.withColumns({"r": row, "v": F.try_parse_json("value")})
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    error = F.when(F.col("v").isNull(), "INVALID_JSON").when(empty(F.col("r.id")), "MISSING_ID").when(empty(F.col("r.url")), "MISSING_URL")
    kept = [c for c in lines.columns if c != "value"]
    return parsed.select("value", *kept, "r.id", "r.url", F.greatest(F.coalesce("r.attempt", F.lit(1)), F.lit(1)).alias("attempt"), error.alias("error"))


def answer(requests: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One result per valid request, ``id, status, code, retryable, body, attempts``; errors become results, never failures.

    ``process`` adds ``body`` and ``failure`` (null, or a code; codes beginning ``TRANSIENT_`` may be retried).
    """
    done = process(requests.where("error is null"))
    ok = F.col("failure").isNull()
    return done.select(
        "id",
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.col("failure").alias("code"),
        F.coalesce(F.col("failure").startswith("TRANSIENT_"), F.lit(False)).alias("retryable"),
        F.when(ok, F.col("body")).alias("body"),
        F.col("attempt").alias("attempts"),
        "url",
    )


def write_batch(df: DataFrame, out: str, kind: str, number: int) -> None:
    """One output of one batch; lines to be retried are text, so that the stream can read them."""
    writer = df.write.mode("overwrite")
    (writer.text if kind == "retry" else writer.parquet)(f"{out}/{kind}/batch={number}")


def run_requests(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 1,
    attempts: int = 3,
    remember: str = "7 days",
    write: Callable[[DataFrame, str, str, int], None] = write_batch,
) -> tuple[DataFrame, DataFrame]:
    """Answer the request files that are there, with their retries, and stop; returns results and dead letters.

    A later call with the same ``out`` and ``checkpoint`` goes on where this one stopped, however it stopped.
    """

    def lines(folder: str) -> DataFrame:
        return spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).text(folder)

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        answered = answer(df, process).persist()
        again = F.col("retryable") & (F.col("attempts") < attempts)
        retry = F.to_json(F.struct("id", "url", (F.col("attempts") + 1).alias("attempt")))
        write(answered.where(~again).drop("url"), out, "results", number)
        write(df.where("error is not null").select("value", "error"), out, "dead", number)
        # As many files as a batch reads: else each shuffle partition leaves one, and batches of a few files multiply with every attempt.
        write(answered.where(again).select(retry.alias("value")).repartition(files_per_batch), out, "retry", number)
        answered.unpersist()
        df.unpersist()

    for folder in (source, f"{out}/retry"):  # a stream needs its folder
        spark.createDataFrame([], "value string").write.mode("append").text(folder)
    first = parse_requests(lines(source)).withColumn("attempt", F.lit(1))
    later = parse_requests(lines(f"{out}/retry"))
    named = first.unionByName(later).withColumn("received", F.current_timestamp())
    # Lines without an id have nothing to be known by: each is a key of its own.
    known = named.withColumn("key", F.when(F.col("error").isNull(), F.concat("id", F.lit("#"), "attempt")).otherwise(F.expr("uuid()")))
    fresh = known.withWatermark("received", remember).dropDuplicatesWithinWatermark(["key"]).drop("key", "received")
    for _ in range(attempts):  # a run sends what failed to the next
        query = fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    read = lambda kind, schema: spark.read.schema(f"{schema}, batch long").parquet(f"{out}/{kind}").drop("batch")
    return read("results", RESULT), read("dead", DEAD)
