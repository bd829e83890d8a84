"""Structured Streaming jobs: incremental ingestion, scoring and dedup.

All three read landed JSON files, run with ``trigger(availableNow=True)``
(process what has landed, then stop) and keep their progress in a
checkpoint location, so a re-run only picks up new files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import model
from ..sources import pages as pg

REVIEW_EVENT = T.StructType([
    T.StructField("review_id", T.LongType()), T.StructField("review_text", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
])


def _run(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_ingest(spark: SparkSession, landing: str, out: str, checkpoint: str,
                  files_per_trigger: int = 2) -> DataFrame:
    """ST1: landed review pages -> flattened RAW rows appended as parquet. Pages and items that do not fit are written
    beside them (``fits=false``), so that rows and quarantine together are all that landed: ``ingest_quarantine``."""
    src = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(landing)
    parsed = pg.parse_pages(src).withColumn("fits", F.col("reason").isNull())
    _run(parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .partitionBy("fits").outputMode("append"))
    return pg.reviews_of(_ingested(spark, out).filter("fits").drop("fits"))


def _ingested(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(T.StructType([*pg.PARSED, T.StructField("fits", T.BooleanType())])).parquet(out)


def ingest_quarantine(spark: SparkSession, out: str) -> DataFrame:
    """What ``stream_ingest`` could not read, with the reason."""
    return pg.quarantined(_ingested(spark, out).filter("not fits"))


def stream_score(spark: SparkSession, landing: str, out: str, checkpoint: str,
                 tok_model: DataFrame, priors: DataFrame, files_per_trigger: int = 2) -> DataFrame:
    """ST2: score arriving reviews with every model (stream-static join in
    ``foreachBatch``). Each micro-batch overwrites its own ``batch_id=``
    folder, so a retried batch does not write twice. The model is prepared and dealt once for all batches; a batch is
    dealt by review while its texts are raw, and the sums come to the cleaned ones."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scorer = model.Scorer(tok_model, priors).keep(n)
    src = (spark.readStream.schema(REVIEW_EVENT).option("maxFilesPerTrigger", files_per_trigger)
           .json(landing))

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        # the micro-batch's cleaned text is read twice by the scoring: keep it
        # for the duration of this batch only (a lost copy is recomputed from
        # the replayable source offsets)
        cleaned = model.fallback_clean_paths(batch.select("review_id", "review_text").repartition(n, "review_id"), ["review_id"]).persist()
        try:
            scored = model.sentiments(scorer.score(cleaned, ["review_id"], carry=("review_text_clean",), dealt=n), ["review_id"])
            scored.write.option("compression", "zstd").mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            cleaned.unpersist()

    try:
        _run(src.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint))
    finally:
        scorer.release()
    return spark.read.parquet(out)


KEPT = ("first", "returned")
DEDUP_OUT = T.StructType([
    T.StructField("text_hash", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("review_id", T.LongType()), T.StructField("review_text", T.StringType()),
    T.StructField("event_time", T.TimestampType()), T.StructField("repeats", T.LongType()),
])


def _seen_texts(ttl_ms: int, mark_ms: int) -> Callable:
    """The step of one text's state: the review that was kept, when the text came last, repeats not yet reported.

    A text that comes again within ``ttl_ms`` is a repeat, and counted. Once it has been away for that long, its timer
    reports the repeats that were left out; the state then stays for ``mark_ms`` as a mark that the text is known, so
    one that comes back is kept as ``returned``, and a second timer removes it."""
    names = DEDUP_OUT.names

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        kept, last, repeats = state.get if state.exists else (None, None, 0)
        report = (key[0], "expired", kept, None, None, repeats)
        if state.hasTimedOut:
            if now - last >= ttl_ms + mark_ms:
                state.remove()
            else:
                state.update((kept, last, 0))
                state.setTimeoutDuration(max(last + ttl_ms + mark_ms - now, 1))
            if repeats:
                yield _frame([report])
            return
        first, n = None, 0
        for b in batches:
            n += int(b["rows"].sum())
            own = b.sort_values(["event_time", "review_id"], na_position="last", kind="stable")
            first = own.head(1) if first is None else pd.concat([first, own.head(1)]).sort_values(
                ["event_time", "review_id"], na_position="last", kind="stable").head(1)
        if last is None or now - last >= ttl_ms:
            new = first.assign(text_hash=key[0], status="first" if last is None else "returned", repeats=0)
            if repeats:  # its timer has not come yet
                yield _frame([report])
            yield new[names]
            kept, repeats = (None if pd.isna(first["review_id"].iloc[0]) else int(first["review_id"].iloc[0])), n - 1
        else:
            repeats += n
        state.update((kept, now, repeats))
        state.setTimeoutDuration(ttl_ms)

    return step


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=DEDUP_OUT.names)
    return out.astype({"review_id": "Int64", "event_time": "datetime64[us]"})


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal texts of a batch as their first row and their number, so that a text of a third of all rows does not
    reach its state row by row."""
    for b in batches:
        first = b.sort_values(["event_time", "review_id"], na_position="last", kind="stable")
        n = first.groupby("text_hash")["text_hash"].transform("size")
        yield first.assign(rows=n)[~first["text_hash"].duplicated()]


def stream_dedup(spark: SparkSession, landing: str, out: str, checkpoint: str, files_per_trigger: int = 2,
                 ttl: timedelta = timedelta(days=30), mark: timedelta = timedelta(days=335)) -> DataFrame:
    """ST3: the rows that are kept, one for each text as long as it comes again within ``ttl`` (processing time).

    The state is keyed by the text's hash and ends ``ttl + mark`` after the text came last, so it is bounded by what
    arrives in that time; a long-running job sets the RocksDB state store so that it lies on disk. No row goes unreported: it is kept as ``first`` or, if its text has been away
    for ``ttl``, as ``returned``; or it is a repeat, counted in its text's ``expired`` row, which is written when the
    text has been away for ``ttl``. ``out`` is a table by status; ``dedup_side`` reads the rows beside the kept ones.
    A null text is a text. There is no watermark: a late row is a row."""
    src = (spark.readStream.schema(REVIEW_EVENT).option("maxFilesPerTrigger", files_per_trigger)
           .json(landing))
    keyed = src.withColumn("text_hash", F.coalesce(F.sha2(F.col("review_text"), 256), F.lit("")))
    combined = keyed.mapInPandas(_combined, T.StructType([*keyed.schema, T.StructField("rows", T.LongType())]))
    ms = lambda d: int(d / timedelta(milliseconds=1))
    rows = combined.groupBy("text_hash").applyInPandasWithState(
        _seen_texts(ms(ttl), ms(mark)), DEDUP_OUT, "review_id long, last_ms long, repeats long", "append",
        GroupStateTimeout.ProcessingTimeTimeout)
    # a state with timers asks for another batch for ever, so a run over what has landed would not end: timers that
    # are due come with the next batch that has data
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")
    try:
        _run(rows.withColumn("text_hash", F.nullif("text_hash", F.lit(""))).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", checkpoint).partitionBy("status").outputMode("append"))
    finally:
        spark.conf.set(idle, before)
    return _dedup_rows(spark, out).filter(F.col("status").isin(*KEPT)).drop("repeats")


def _dedup_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(DEDUP_OUT).parquet(out)


def dedup_side(spark: SparkSession, out: str) -> DataFrame:
    """text_hash, status, review_id, repeats: kept rows of texts that returned, and the repeats of expired texts."""
    return _dedup_rows(spark, out).filter("status <> 'first'").select("text_hash", "status", "review_id", "repeats")
