"""Structured Streaming forms of the roll-ups, limits, debounced queues and idempotent keys.

The events table comes as several files in order of arrival, one a batch, so batches, late rows and state are real: every
fiftieth event arrives with the next file (about six days late).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.sinks import VersionedTable
from tidemark.plans.registry import frame, query
from tidemark.session import shared_folder

FILES = 6
#: The file in which an event comes, in SQL.
ARRIVAL = "CAST(least(4, floor((day(ts) - 1) / 6)) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS INT)"


def event_stream(spark: SparkSession, sf_dir: str, late: bool = True) -> DataFrame:
    """The events as a stream of FILES files; without `late` each comes with its own days."""
    path = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    rows = frame(spark, sf_dir, f"SELECT *, {ARRIVAL if late else ARRIVAL.replace('% 50 = 0', '< 0')} AS arrival FROM events")
    for number in range(FILES):  # one after another: a file source reads files in the order of their times
        rows.filter(F.col("arrival") == number).drop("arrival").coalesce(1).write.parquet(f"{path}/{number}")
    stream = spark.readStream.schema(rows.drop("arrival").schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Run the stream over what is there, one file a batch, and return every row that it let out with its `_batch`."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{number}")  # a batch run again replaces itself

    stream.writeStream.outputMode(mode).option("checkpointLocation", path + "/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(path + "/out")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the RocksDB store; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, own) if own else spark.conf.unset(name)


def newest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The last batch's values of each key: a re-rolled hour replaces what was rolled before."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_batch").alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in columns])


def hourly(stream: DataFrame, late: str) -> DataFrame:
    """hour, event_type, n, cost: rows up to `late` behind the newest are rolled into their hour again, others are dropped."""
    rolled = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("cost"))
    out = run_available(rolled.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "cost"))
    return newest(out, ["hour", "event_type"], ["n", "cost"])


_ROLL = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM {} GROUP BY 1, 2"
#: What a batch may still take: its rows' hours end after the bound that held in the batch before, the newest time of the
#: batches before that one less six hours.
_TAKEN = f"""(WITH a AS (SELECT *, {ARRIVAL} AS arrival FROM events), m AS (SELECT arrival, max(ts) AS newest FROM a GROUP BY arrival),
    seen AS (SELECT a.*, (SELECT max(newest) FROM m WHERE m.arrival < a.arrival - 1) AS before FROM a)
    SELECT * FROM seen WHERE before IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > before - INTERVAL 6 HOUR)"""


@query("st_tumbling_hour", _ROLL.format("events"))
def st_tumbling_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows within the bound (here two weeks) change their hours after these were rolled first."""
    return hourly(event_stream(spark, sf_dir), "14 days")


@query("st_late_bound", _ROLL.format(_TAKEN))
def st_late_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a bound of six hours, hours behind it are never rolled again."""
    return hourly(event_stream(spark, sf_dir), "6 hours")


@query("st_tumbling_minute_limit", "SELECT user_id % 5 AS tenant, date_trunc('minute', ts) AS minute, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY 1, 2")
def st_tumbling_minute_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = event_stream(spark, sf_dir, late=False).withWatermark("ts", "10 minutes").withColumn("tenant", F.col("user_id") % 5)
    counted = stream.groupBy("tenant", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    out = run_available(counted.select("tenant", F.col("w.start").cast("timestamp_ntz").alias("minute"), "n", (F.col("n") > 1).alias("limited")))
    return newest(out, ["tenant", "minute"], ["n", "limited"])


#: Attempts in a window, failures before the first wait, the first and the longest wait (seconds).
ATTEMPTS, FAILURES, FIRST_WAIT, LONGEST_WAIT = 6, 2, 30, 900


@query(
    "st_login_window",
    f"""SELECT user_id % 20 AS ip, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01 00:00:00') AS since, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) > {ATTEMPTS} AS limited,
    CAST(CASE WHEN count(*) FILTER (WHERE event_type = 'error') < {FAILURES} THEN 0 ELSE least({LONGEST_WAIT}, {FIRST_WAIT} * pow(2, count(*) FILTER (WHERE event_type = 'error') - {FAILURES})) END AS INT) AS wait FROM events GROUP BY 1, 2""",
)
def st_login_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and failures of an address in fixed windows; the wait doubles with each failure from the threshold on."""
    stream = event_stream(spark, sf_dir, late=False).withWatermark("ts", "6 hours").withColumn("ip", F.col("user_id") % 20)
    failures = F.count_if(F.col("event_type") == "error")
    counted = stream.groupBy("ip", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), failures.alias("failures"))
    wait = F.when(F.col("failures") < FAILURES, 0).otherwise(F.least(F.lit(LONGEST_WAIT), FIRST_WAIT * F.pow(F.lit(2.0), F.col("failures") - FAILURES))).cast("int")
    out = run_available(counted.select("ip", F.col("w.start").cast("timestamp_ntz").alias("since"), "n", "failures", (F.col("n") > ATTEMPTS).alias("limited"), wait.alias("wait")))
    return newest(out, ["ip", "since"], ["n", "failures", "limited", "wait"])


#: Seconds that a queued job waits for more, and that it waits at most.
DEBOUNCE, LONGEST = 1800, 7200


def debounced(stream: DataFrame, key: str) -> DataFrame:
    """Jobs (key, created, run_after, n) of a stream in time order: an enqueue joins the key's queued job and puts it off,
    until the job runs; then the next one opens a new job. A job is put out again whenever it changes. A job that has run
    leaves the state with the watermark, so the state holds waiting jobs only. The stream has a watermark on ts."""

    def absorb(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the job has run; the next enqueue opens a new one
            state.remove()
            return
        job, changed = (list(state.get) if state.exists else None), {}
        times = pd.concat([b["ts"] for b in batches]).sort_values()
        for t in (x.timestamp() for x in times):
            if job is None or t >= job[1]:
                job = [t, t + DEBOUNCE, 1]
            else:
                job = [job[0], max(job[1], min(job[0] + LONGEST, t + DEBOUNCE)), job[2] + 1]
            changed[job[0]] = list(job)
        runs = int(job[1] * 1000)
        if runs > state.getCurrentWatermarkMs():
            state.update(tuple(job))
            state.setTimeoutTimestamp(runs)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(keys[0], *j) for j in changed.values()], columns=[key, "created", "run_after", "n"])

    kind = stream.schema[key].dataType.simpleString()
    out = f"{key} {kind}, created double, run_after double, n bigint"
    return stream.select(key, "ts").groupBy(key).applyInPandasWithState(absorb, out, "created double, run_after double, n bigint", "update", GroupStateTimeout.EventTimeTimeout)


@query(
    "st_debounce",
    f"""WITH RECURSIVE e AS (SELECT user_id % 50 AS kind, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS i FROM events),
    j AS (SELECT kind, i, t AS created, t + {DEBOUNCE} AS run_after, 1 AS n FROM e WHERE i = 1
        UNION ALL SELECT e.kind, e.i, CASE WHEN t >= run_after THEN t ELSE created END, CASE WHEN t >= run_after THEN t + {DEBOUNCE} ELSE greatest(run_after, least(created + {LONGEST}, t + {DEBOUNCE})) END, CASE WHEN t >= run_after THEN 1 ELSE n + 1 END FROM j JOIN e ON e.kind = j.kind AND e.i = j.i + 1)
    SELECT kind, CAST(round(created) AS BIGINT) AS created, CAST(round(max(run_after)) AS BIGINT) AS run_after, CAST(max(n) AS BIGINT) AS n FROM j GROUP BY kind, created""",
)
def st_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = event_stream(spark, sf_dir, late=False).withWatermark("ts", "1 hour").withColumn("kind", F.col("user_id") % 50)
    jobs = newest(run_available(debounced(stream, "kind")), ["kind", "created"], ["run_after", "n"])
    return jobs.select("kind", *[F.round(c).cast("bigint").alias(c) for c in ("created", "run_after")], "n")


@query("st_idempotency_key", "SELECT DISTINCT user_id, event_type FROM events")
def st_idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a key, ever: the keys stay in the state store, however late one comes again."""
    stream = event_stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return run_available(stream, "append").select("user_id", "event_type")


@query(
    "st_lease_table",
    "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS status, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' THEN 2 ELSE 1 END AS attempt FROM orders",
)
def st_lease_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form on a table of jobs: those that run past their lease go back to the queue with one more attempt; reaping
    again changes nothing."""
    jobs = VersionedTable(spark, f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}")
    jobs.replace(frame(spark, sf_dir, "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS status, 1 AS attempt, o_orderdate AS locked_until FROM orders"))
    expired = (F.col("status") == "running") & (F.col("locked_until") < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
    for _ in range(2):
        jobs.replace(jobs.read().select("id", F.when(expired, "queued").otherwise(F.col("status")).alias("status"), (F.col("attempt") + expired.cast("int")).alias("attempt"), "locked_until"))
    return jobs.read().select("id", "status", "attempt")


#: Minutes that a claim or heartbeat holds a job, and attempts before it fails for good.
LEASE_MINUTES, MOST_ATTEMPTS = 6 * 60, 3
_REAPED = T.StructType([T.StructField("job", T.LongType()), T.StructField("expired_ms", T.LongType()), T.StructField("attempt", T.IntegerType()), T.StructField("status", T.StringType())])


class LeaseReaper(StatefulProcessor):
    """One state a job: until when its lease runs, and its attempt. A row without `done` claims the job or renews its lease,
    one with `done` ends it. A lease that runs out, by the next row of the job or by the watermark, puts the job back in the
    queue with one more attempt, or lets it fail after the last. The state goes when a job is done or has failed; it is
    empty of a lease, and keeps the attempt, while the job waits in the queue."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", T.StructType([T.StructField("until", T.LongType()), T.StructField("attempt", T.IntegerType())]))

    def _expired(self, key: tuple, until: int, attempt: int) -> tuple[tuple, int]:
        failed = attempt >= MOST_ATTEMPTS
        return (key[0], until, attempt, "failed" if failed else "queued"), 1 if failed else attempt + 1

    def _hold(self, until: int, attempt: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until:
            self.handle.registerTimer(until)
        if until or attempt > 1:
            self.job.update((until, attempt))
        elif self.job.exists():
            self.job.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until, attempt = self.job.get() if self.job.exists() else (0, 1)
        out = []
        for ms, done in sorted(x for part in rows for x in zip(part["ms"].tolist(), part["done"].tolist(), strict=True)):
            if until and ms > until:
                gone, attempt = self._expired(key, until, attempt)
                out.append(gone)
            until, attempt = (0, 1) if done else (ms + LEASE_MINUTES * 60_000, attempt)
        if until and until <= timerValues.getCurrentWatermarkInMs():
            gone, attempt = self._expired(key, until, attempt)
            out, until = [*out, gone], 0
        self._hold(until, attempt)
        yield pd.DataFrame(out, columns=_REAPED.names)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until, attempt = self.job.get()
        gone, attempt = self._expired(key, until, attempt)
        self._hold(0, attempt)
        yield pd.DataFrame([gone], columns=_REAPED.names)

    def close(self) -> None:
        pass


def reaped(stream: DataFrame) -> DataFrame:
    """job, expired_ms, attempt, status: leases that run out; stream: job, ts (with a watermark), ms (of ts), done."""
    return stream.groupBy("job").transformWithStateInPandas(statefulProcessor=LeaseReaper(), outputStructType=_REAPED, outputMode="append", timeMode="eventTime")


@query(
    "st_lease_reaper",
    f"""WITH e AS (SELECT user_id AS job, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AS done, event_id FROM events),
    n AS (SELECT *, lead(ms) OVER w AS next, count(*) FILTER (WHERE done) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS finished FROM e WINDOW w AS (PARTITION BY job ORDER BY ms, done, event_id)),
    x AS (SELECT job, ms + {LEASE_MINUTES * 60_000} AS expired_ms, row_number() OVER (PARTITION BY job, finished ORDER BY ms, event_id) AS k FROM n WHERE NOT done AND coalesce(next, 1e18) > ms + {LEASE_MINUTES * 60_000}),
    t AS (SELECT *, (k - 1) % {MOST_ATTEMPTS} + 1 AS attempt FROM x WHERE expired_ms < (SELECT max(epoch_us(ts) // 1000) FROM events) - 60_000)
    SELECT job, CAST(expired_ms AS BIGINT) AS expired_ms, CAST(attempt AS INT) AS attempt, CASE WHEN attempt = {MOST_ATTEMPTS} THEN 'failed' ELSE 'queued' END AS status FROM t""",
)
def st_lease_reaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs: any event claims or renews, a purchase ends; leases run out with event time, without a further row."""
    stream = event_stream(spark, sf_dir, late=False).withWatermark("ts", "1 minute")
    rows = stream.select(F.col("user_id").alias("job"), "ts", F.unix_millis("ts").alias("ms"), (F.col("event_type") == "purchase").alias("done"))
    with rocksdb_state(spark):
        out = run_available(reaped(rows), "append")
    return out.select(*_REAPED.names)
