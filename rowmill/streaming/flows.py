"""Incremental ingest and deduplication with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, dirs, schema, fmt: str = "parquet", archive: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """New files of several folders as one stream: what arrives, and what was repaired by hand and put back. Files that are done move to `archive`."""

    def one(path: str) -> DataFrame:
        reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger)
        if archive:
            reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
        return reader.load(path).withColumn("source_file", F.element_at(F.split("_metadata.file_path", "/"), -1))

    return reduce(DataFrame.unionByName, [one(d) for d in dirs])


def stream_ingest(stream: DataFrame, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None, bad: str = "false", audit: str | None = None) -> StreamingQuery:
    """Run `step` on each batch of new files, once. Rows for which the SQL condition `bad` holds go aside, the rest to the sink.

    A batch is written under its number, so a batch that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = step(batch) if step else batch
        good, aside = rows.where(f"not coalesce({bad}, false)"), rows.where(bad)
        good.write.mode("overwrite").parquet(f"{sink}/rows/batch={number}")
        aside.write.mode("overwrite").parquet(f"{sink}/quarantine/batch={number}")
        if audit:
            rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.expr(bad)).alias("n_aside")).write.mode("overwrite").parquet(f"{audit}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_arrivals(spark: SparkSession, dirs, archive: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """The paths of new files of several folders as a stream; nothing is read of what they hold."""

    def one(path: str) -> DataFrame:
        reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger)
        if archive:
            reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
        return reader.load(path).select("path", "length")

    return reduce(DataFrame.unionByName, [one(d) for d in dirs])


#: What Spark says where a file, and not the work, is at fault.
FILE_FAULTS = ("FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "MALFORMED_RECORD_IN_PARSING", "MALFORMED_CSV_RECORD", "is not a Parquet file", "Malformed ORC file")


def _file_fault(error: Exception) -> str | None:
    text = str(error)
    return next((f for f in FILE_FAULTS if f in text), None)


def split_readable(read: Callable[[list[str]], DataFrame], paths: list[str]) -> tuple[list[str], dict[str, str]]:
    """(paths that can be read, what is wrong with the others). Halves of what fails are tried again, so a few broken files
    among many cost a few short jobs; a failure that is no file's fault is raised."""
    good, broken, open_ = [], {}, [paths]
    while open_:
        some = open_.pop()
        try:
            if some:
                read(some).write.format("noop").mode("overwrite").save()
            good += some
        except (PySparkException, Py4JJavaError) as error:
            fault = _file_fault(error)
            if fault is None:
                raise
            if len(some) == 1:
                broken[some[0]] = fault
            else:
                open_ += [some[: len(some) // 2], some[len(some) // 2 :]]
    return good, broken


def ingest_files(arrivals: DataFrame, read: Callable[[list[str]], DataFrame], sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None, bad: str = "false") -> StreamingQuery:
    """Run `step` on the rows of each batch of new files, once. Rows for which `bad` holds go aside, and so does a file that
    cannot be read: its bytes, name and fault. The run goes on with the others.

    A batch is read and written at once; only where that fails are its files tried apart. It is written under its number, so a
    batch that is repeated replaces itself. Paths of a batch are as many as the stream's files a trigger.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        paths, broken = sorted(r.path for r in batch.select("path").collect()), {}
        place = lambda kind: f"{sink}/{kind}/batch={number}"

        def deliver(some: list[str]) -> None:
            rows = read(some)
            rows = step(rows) if step else rows
            rows.where(f"not coalesce({bad}, false)").write.mode("overwrite").parquet(place("rows"))
            rows.where(bad).write.mode("overwrite").parquet(place("quarantine"))

        try:
            deliver(paths)
        except (PySparkException, Py4JJavaError) as error:
            if _file_fault(error) is None:
                raise
            paths, broken = split_readable(read, paths)
            if paths:
                deliver(paths)
        faults = spark.createDataFrame(list(broken.items()), "path string, fault string")
        bytes_ = spark.read.format("binaryFile").load(list(broken)) if broken else None
        aside = bytes_.join(F.broadcast(faults), "path") if broken else faults.withColumns({"length": F.lit(0).cast("long"), "content": F.lit(None).cast("binary")})
        aside.select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), "fault", "length", "content").write.mode("overwrite").parquet(place("broken"))

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(stream: DataFrame, keys, event_time: str, lateness: str) -> DataFrame:
    """The first arrival of each key within the watermark; state older than that is dropped."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, event_time: str, width: str, keys, lateness: str) -> DataFrame:
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, width), *keys).agg(F.count(F.lit(1)).alias("n_rows"))


def held_first(stream: DataFrame, keys, order: str, event_time: str, hold: str, lateness: str, buckets: int = 4096) -> DataFrame:
    """The first row of each key by `order`, whenever it arrives: a key's best row so far is held from its first event on
    for `hold`, then goes out and the key is forgotten.

    Rows older than the watermark, and rows without a time, are dropped; rows without a number come last. Of each key one row
    is kept; `order` is a whole number. Rows travel as JSON, so every type that JSON can hold comes back as it was.

    A call of the state function costs milliseconds whatever it gets, so keys share one: a state holds the keys of a bucket of
    their hash, with a timer for the first that is due. A batch rewrites the buckets it has rows of. `buckets` must stay the
    same for a checkpoint; more of them keep states small where many millions of keys are held at a time.
    """
    wait = int(stream.sparkSession.sql(f"select unix_micros(timestamp '2000-01-01 00:00:00' + interval {hold}) - unix_micros(timestamp '2000-01-01 00:00:00') as x").first().x) // 1000
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    types = dict(stream.dtypes)
    place = F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1))
    # a key's text; zero has one sign only, as it has for groups
    key = F.to_json(F.struct(*[(F.col(k) + F.lit(0.0) if types.get(k) in ("float", "double") else F.col(k)).alias(k) for k in keys]), form)
    rows = stream.withWatermark(event_time, lateness).where(F.col(event_time).isNotNull())
    rows = rows.select(event_time, key.alias("__key"), place.alias("__place"), F.to_json(F.struct(*stream.columns), form).alias("__row"), F.unix_millis(event_time).alias("__begun"))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)))

    def hold_first(_, frames, state: GroupState):
        import pandas as pd

        now = state.getCurrentWatermarkMs()
        held = {k: (p, r, d) for k, p, r, d in zip(*state.get)} if state.exists else {}
        fresh = set()
        for frame in () if state.hasTimedOut else frames:
            for k, p, r, b in zip(*(frame[x].tolist() for x in ("__key", "__place", "__row", "__begun"))):
                place, row, due = held.get(k, (p, r, b + wait))
                held[k] = (*min((place, row), (p, r)), min(due, b + wait))
                fresh.add(k)
        for k in fresh:  # a key with new rows stays at least until the watermark moves on
            place, row, due = held[k]
            held[k] = (place, row, max(due, now + 1))
        out = [k for k, (_, _, due) in held.items() if due < now]
        done = [held.pop(k)[1] for k in out]
        if held:
            state.update(([*held], *([*x] for x in zip(*held.values()))))
            state.setTimeoutTimestamp(min(due for _, _, due in held.values()))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({"__row": done})

    kept = "keys array<string>, places array<long>, rows array<string>, dues array<long>"
    out = rows.groupBy("__bucket").applyInPandasWithState(hold_first, "__row string", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json("__row", stream.schema, form).alias("x")).select("x.*")
