"""Continuous ingest: bodies in, log rows and rejections out."""

from __future__ import annotations

from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallylog.operators.validation import accepted_entries, batch_outcome, rejected_entries, validate
from tallylog.session import configure, shared_folder
from tallylog.sources.envelopes import explode_entries, parse_envelopes
from tallylog.sources.log_table import LogTable, OutcomeTable, RejectTable


def store(
    validated: DataFrame,
    logs: LogTable,
    rejects: RejectTable,
    load: str,
    replay: bool = False,
    outcomes: OutcomeTable | None = None,
) -> tuple[int, int]:
    """Write accepted and rejected entries; returns how many of each.

    The validated rows are kept for the later writes, on disk where memory is
    short; a lost executor's part is computed again from the source. With
    ``replay`` the load may have been written in part before, and only what is
    missing is added. The outcome of each delivery is written last, so one that has an
    outcome is stored as a whole.
    """
    validated = validated.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        accepted, rejected = accepted_entries(validated), rejected_entries(validated)
        if replay:
            counts = logs.append_missing(accepted, load), rejects.append_missing(rejected, load)
        else:
            counts = logs.append(accepted, load), rejects.append(rejected, load)
        if outcomes is not None:
            made = batch_outcome(validated).withColumn("batch_id", F.col("batch_id").cast("string"))
            outcomes.append_missing(made, load) if replay else outcomes.append(made, load)
        return counts
    finally:
        validated.unpersist()


def start_ingest(
    bodies: DataFrame,
    logs: LogTable,
    rejects: RejectTable,
    name: str,
    as_of: Column | datetime | None = None,
    checkpoint: str | None = None,
    available_now: bool = False,
    interval: str = "10 seconds",
    outcomes: OutcomeTable | None = None,
) -> StreamingQuery:
    """Start a stream from ``batch_id, raw`` bodies into the tables.

    A micro-batch counts as done only after all writes; its number is then
    committed. After a restart the first micro-batch may be one that was cut
    short, so it adds only what is missing; the ones after it cannot be, and
    are appended without looking at the table. Validation runs in the stream's
    own plan, where the current time is fixed per micro-batch and kept for a
    replay. Late rows go to their own day, so there is no watermark.

    ``available_now`` takes what there is, in micro-batches of the source's size
    limit, and stops; that is also the way to load a backlog.
    """
    configure(logs.spark)
    entries = explode_entries(parse_envelopes(bodies))
    validated = validate(entries, as_of if as_of is not None else F.current_timestamp(), "validation")
    first = [True]

    def write(batch: DataFrame, number: int) -> None:
        store(batch, logs, rejects, load=f"{name}/{number:012d}", replay=first[0], outcomes=outcomes)
        first[0] = False

    writer = (
        validated.writeStream.queryName(name)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint or f"{shared_folder(logs.spark)}/streams/{name}")
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
