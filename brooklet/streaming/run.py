"""Running a job: as streaming queries, or once over batch inputs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from brooklet.metrics import Counters
from brooklet.operators.hotkeys import GROUP_ROWS
from brooklet.plans.job import BuiltJob, Output, Records, build_job, take
from brooklet.plans.spec import CHECKPOINT_INTERVAL_MS, Job
from brooklet.session import scratch_path, shared_dir
from brooklet.sinks.buckets import bucket_stream, write_buckets
from brooklet.sinks.ledger import JdbcStore, Store, append_once, ledger_setup, query_id
from brooklet.sinks.topics import topic_writer
from brooklet.sinks.warehouse import Warehouse, append_rows, run_init

BatchWriter = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Targets:
    """What the sinks need besides their description in the job.

    ``writers`` replaces sinks by name; ``execute_sql`` runs a sink's set-up
    statement; ``bucket_path`` turns a bucket's address into a path.  ``gather``
    brings the records of a title together before they are written, so that
    every title gets few files; it costs a shuffle.

    With ``ledger``, the name of a table, warehouse rows of streaming jobs are
    written exactly once: the database then also holds that table and a staging
    table per query (``sinks.ledger``).  ``store`` replaces the JDBC connection.
    """

    writers: Mapping[str, BatchWriter] = field(default_factory=dict)
    user: str | None = None
    password: str | None = None
    execute_sql: Callable[[Mapping], None] | None = None
    transient: type[Exception] | tuple[type[Exception], ...] = ConnectionError
    bucket_path: str = "s3a://{address}/"
    rows_per_file: int = 0
    gather: bool = True
    ledger: str | None = None
    store: Callable[[Warehouse], Store] = JdbcStore

    def prepare(self, job: Job) -> None:
        """Run the set-up statements of the warehouse sinks, and make the ledger."""
        for name, sink in (job.get("sinks") or {}).items():
            if sink.get("init_sql") and name not in self.writers:
                if self.execute_sql is None:
                    raise ValueError(f"sink {name!r} has a set-up statement, but nothing to run it with")
                run_init(lambda sink=sink: self.execute_sql(sink), self.transient)
            if self.ledger is not None and sink["sink_type"] == "greenplum" and name not in self.writers:
                store = self.store(Warehouse(sink["address"], sink["database"], sink["table"], self.user, self.password))
                run_init(lambda store=store: store.run(ledger_setup(self.ledger)), self.transient)

    def batch_writer(self, output: Output) -> BatchWriter:
        """Function that appends one batch to the output's sink: at least once, or exactly once by the ledger."""
        target, kind = output.target, output.target["sink_type"]
        if output.sink in self.writers:
            return self.writers[output.sink]
        if kind == "kafka":
            return lambda df, _: topic_writer(df, target["address"], target["topic"]).save()
        if kind == "greenplum":
            warehouse = Warehouse(target["address"], target["database"], target["table"], self.user, self.password)
            if self.ledger is not None:
                store = self.store(warehouse)
                return lambda df, batch: append_once(df, batch, f"{query_id(df)}:{output.label}", warehouse.table, target["schema"], self.ledger, store)
            return lambda df, _: append_rows(df, warehouse, target["schema"])
        path = self.bucket_path.format(address=target["address"])
        return lambda df, _: write_buckets(df, path, target.get("title_field"), self.rows_per_file, gather=self.gather)

    def stream_writer(self, output: Output) -> DataStreamWriter:
        """Streaming writer for one output; bucket files are written exactly once, the rest at least once."""
        target, kind = output.target, output.target["sink_type"]
        if output.sink not in self.writers and kind == "kafka":
            return topic_writer(output.rows, target["address"], target["topic"])
        if output.sink not in self.writers and kind == "minio":
            path = self.bucket_path.format(address=target["address"])
            return bucket_stream(output.rows, path, target.get("title_field"), self.rows_per_file, self.gather)
        return output.rows.writeStream.foreachBatch(self.batch_writer(output))

    def pure_stream(self, output: Output, shared: bool) -> bool:
        """Is the output written by a streaming sink of Spark's own?  Bucket files always are, topics unless reads are shared."""
        return output.sink not in self.writers and output.target["sink_type"] in (("minio",) if shared else ("minio", "kafka"))


def start_job(
    spark: SparkSession,
    job: Job,
    name: str,
    inputs: Mapping[str, Records] | None = None,
    lookup: Callable[[], DataFrame] | DataFrame | None = None,
    targets: Targets = Targets(),
    lateness: str | None = None,
    ordered: bool = False,
    available_now: bool = False,
    shared_reads: bool = True,
    rows_per_trigger: int | None = None,
    keep_state: bool = False,
    publish: Callable[[str, dict[str, int]], None] | None = None,
) -> list[StreamingQuery]:
    """Start the streaming queries of a job; state and progress live below the shared folder under ``name``.

    The result of every stateful operator is landed as a table there, so that
    all outputs and clones behind it use it without computing it again.
    ``shared_reads`` writes all at-least-once outputs of a stretch from one
    query, which reads its input once; without it every output has a query of
    its own.  ``available_now`` processes what is there and stops.  Starting
    again with the same name continues after the last finished micro-batch.

    Stateful operators need ``lateness``, behind which state is let go, or
    ``keep_state``, which keeps the state of every key for good.
    ``rows_per_trigger`` (or the setting of that name) bounds what a micro-batch
    takes from a topic, and with it what a hot key can have in one; without it
    the first one is the whole topic.

    Counters of operators whose rows go through ``foreachBatch`` are given to
    ``publish`` (query name, values) after each micro-batch; those of the other
    queries are in their progress, see ``metrics.CounterListener``.  Every
    operator is counted once.
    """
    stateful = {"deduplicator", "stream_joiner"}
    if lateness is None and not keep_state:
        for source, chain in (job.get("operators") or {}).items():
            if any(operator.get("operator_type") in stateful for operator in chain):
                raise ValueError(f"the chain of {source!r} keeps state: give a lateness, or keep_state=True")
    root = f"{shared_dir(spark).rstrip('/')}/jobs/{name}"
    settings = job.get("settings") or {}
    interval = settings.get("checkpoint_interval") or CHECKPOINT_INTERVAL_MS
    writers: list[tuple[str, DataStreamWriter]] = []

    def land(df: DataFrame, label: str) -> DataFrame:
        path = f"{root}/landed/{label}"
        _make_folder(spark, path)
        writers.append((f"landed-{label}", df.writeStream.format("parquet").option("path", path)))
        return spark.readStream.schema(df.schema).parquet(path)

    limit = rows_per_trigger or settings.get("rows_per_trigger")
    queries = []
    with _parallelism(spark, job):
        built = build_job(spark, job, inputs, lookup, land, lateness, ordered, rows_per_trigger=limit)
        targets.prepare(job)
        batched = [output for output in built.outputs if not targets.pure_stream(output, shared_reads)]
        for output in built.outputs:
            if output not in batched:
                writers.append((output.label, targets.stream_writer(output)))
        for group in _by_trunk(batched) if shared_reads else [[output] for output in batched]:
            label = "+".join(output.label for output in group)
            writers.append((label, _shared_writer(group, targets, f"{name}:{label}", publish)))
        for label, writer in writers:
            writer = writer.queryName(f"{name}:{label}").option("checkpointLocation", f"{root}/checkpoints/{label}")
            if available_now:
                # Landed tables are filled before the queries that read them.
                query = writer.trigger(availableNow=True).start()
                query.awaitTermination()
            else:
                query = writer.trigger(processingTime=f"{interval} milliseconds").start()
            queries.append(query)
    return queries


def await_job(queries: Sequence[StreamingQuery], seconds: float | None = None) -> bool:
    """Wait for all queries of a job; when one fails the others are stopped and its error is raised.

    ``seconds`` bounds the wait; the answer tells whether all queries have ended.
    """
    until = None if seconds is None else time.monotonic() + seconds
    try:
        while any(query.isActive for query in queries):
            for query in queries:
                if query.exception() is not None:
                    raise query.exception()
            if until is not None and time.monotonic() > until:
                return False
            time.sleep(0.1)
        for query in queries:
            if query.exception() is not None:
                raise query.exception()
    except BaseException:
        for query in queries:
            query.stop()
        raise
    return True


def run_batch(
    spark: SparkSession,
    job: Job,
    inputs: Mapping[str, Records] | None = None,
    lookup: DataFrame | None = None,
    targets: Targets = Targets(),
    group_rows: int | None = GROUP_ROWS,
) -> BuiltJob:
    """Run a job once over what its inputs hold now.

    A stateful result that is read several times is written to the shared folder
    first, so that it is shuffled once and survives lost executors.  So is what
    several outputs have in common: an input is read once, also where reading it
    again would find more.
    """

    def land(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, f"landed-{label}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    with _parallelism(spark, job):
        built = build_job(spark, job, inputs, lookup, land, group_rows=group_rows, streaming=False)
        targets.prepare(job)
        for group in _by_trunk(built.outputs):
            if len(group) == 1:
                targets.batch_writer(group[0])(group[0].rows, 0)
                continue
            shared = _shared_steps(group)
            counted = [step for output in group for step in output.counted]
            rows = take(group[0].stream.trunk, shared, counted, built.counters)
            rows = land(rows, "+".join(output.label for output in group))
            for output in group:
                targets.batch_writer(output)(output.rows_of(rows, built.counters, len(shared)), 0)
    return built


@contextmanager
def _parallelism(spark: SparkSession, job: Job) -> Iterator[None]:
    """The job's number of shuffle partitions, while its plans are made; the session gets its own back.

    A streaming query keeps the settings it was started with.
    """
    wanted, name = (job.get("settings") or {}).get("parallelism"), "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        if wanted:
            spark.conf.set(name, wanted)
        yield
    finally:
        spark.conf.set(name, before)


def _shared_steps(group: list[Output]) -> tuple:
    """The steps all outputs begin with."""
    shared = []
    for steps in zip(*(output.stream.steps for output in group)):
        if any(step is not steps[0] for step in steps):
            break
        shared.append(steps[0])
    return tuple(shared)


def _by_trunk(outputs: list[Output]) -> list[list[Output]]:
    groups: dict[int, list[Output]] = {}
    for output in outputs:
        groups.setdefault(id(output.stream.trunk), []).append(output)
    return list(groups.values())


def _shared_writer(
    group: list[Output], targets: Targets, name: str, publish: Callable[[str, dict[str, int]], None] | None
) -> DataStreamWriter:
    """One query for all outputs of ``group``; their steps are taken, and counted, on each micro-batch."""
    writers = [(output, targets.batch_writer(output)) for output in group]

    def write(batch: DataFrame, batch_id: int) -> None:
        counters = Counters()
        batch.persist()
        try:
            for output, writer in writers:
                writer(output.rows_of(batch, counters), batch_id)
        finally:
            batch.unpersist()
        if publish is not None:
            publish(name, counters.batch_values(wait=10))

    return group[0].stream.trunk.writeStream.foreachBatch(write)


def _make_folder(spark: SparkSession, path: str) -> None:
    """A file stream needs its folder to exist before the first file is written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
