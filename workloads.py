"""The registered queries: one or more per operator, each with its SQL counterpart.

Every query reads its whole tables.  ``QUERIES`` maps a name to a function of
(session, table folder); ``SQL`` holds the same result as DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet import functions as bf
from brooklet.metrics import query_totals
from brooklet.operators import change_field, create_field, dedup, delete_field, enrich, filter_rows, pair_join
from brooklet.operators import enrich_as_of as as_of
from brooklet.operators.hotkeys import GROUP_ROWS
from brooklet.plans import Records, build_job
from brooklet.session import scratch_path, shared_dir, work_path
from brooklet.sinks import bucket_stream, json_value, read_buckets, table_columns, write_buckets
from brooklet.sources import decode_json, file_records, lookup_table, topic_records
from brooklet.streaming import Targets, run_batch, start_job
from brooklet.streaming.resume import files_read, kept_state

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HOUR = 3_600
DAY = 86_400
MONTH = 30 * DAY


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            SQL[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream; what is there forms one micro-batch, which the operators put in order."""
    schema = table(spark, folder, name).schema
    # The pattern fits a single file as well as a folder of files.
    return file_records(spark, f"{folder}/{name}.parquet*", schema, "parquet", streaming=True)


def stream_in_parts(spark: SparkSession, folder: str, name: str, ts: str, parts: int = 2) -> DataFrame:
    """The table as a stream of several micro-batches in order of time, each of as many files as there are shuffle partitions.

    Rows without time belong to the last part, so that the operators see (and refuse) them.
    """
    rows, path = table(spark, folder, name), scratch_path(spark, f"{name}-parts")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in time_parts(rows, ts, parts):
        part.repartition(files).write.mode("append").parquet(path)  # files are read in the order in which they are written
    return file_records(spark, path, rows.schema, "parquet", streaming=True, files_per_trigger=files)


def time_parts(rows: DataFrame, ts: str, parts: int) -> Iterator[DataFrame]:
    cuts = rows.select(F.percentile_approx(ts, [place / parts for place in range(1, parts)])).first()[0] or []
    for begin, end in zip([None, *cuts], [*cuts, None]):
        part = rows if begin is None else rows.filter((F.col(ts) >= F.lit(begin)) | F.col(ts).isNull())
        yield part if end is None else part.filter(F.col(ts) < F.lit(end))


def finished(spark: SparkSession, df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Result table of a streaming query that has processed all present input; its checkpoint is ``path``/progress."""
    path = path or scratch_path(spark, label)
    writer = df.writeStream.format("parquet").option("path", f"{path}/rows")
    writer.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def batch_folders(spark: SparkSession, label: str):
    """A path, and a writer that keeps each micro-batch in a folder of its own below it, so that a repeated one replaces itself."""
    path = scratch_path(spark, label)
    return path, lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """What such a writer has written; empty when there was no micro-batch."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}/batch=*") if _exists(spark, path) else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def share(df: DataFrame, part: int) -> int:
    """Rows that make a key hot: one ``part``-th of the table, but never more than one task should sort."""
    return min(GROUP_ROWS, max(1, df.count() // part))


def hottest(df: DataFrame, key: str) -> int:
    """Rows that make a key hot: nine tenths of what the largest key has, so that some are hot at every scale."""
    return min(GROUP_ROWS, max(1, df.groupBy(key).count().agg(F.max("count")).first()[0] * 9 // 10))


def customer_names(spark: SparkSession, folder: str, segment: str | None = None) -> DataFrame:
    """Lookup from customer number to name, optionally of one market segment only."""
    customers = table(spark, folder, "customer")
    if segment is not None:
        customers = customers.filter(F.col("c_mktsegment") == segment)
    return lookup_table(customers, "c_custkey", "c_name")


# --- per-row operators


@register("SELECT * FROM events WHERE value > 20")
def filter_by_condition(spark, folder):
    return filter_rows(table(spark, folder, "events"), "value > 20")


@register("SELECT * FROM lineitem WHERE l_discount IS NOT NULL AND l_discount <> 0")
def filter_truthy_number(spark, folder):
    return filter_rows(table(spark, folder, "lineitem"), "l_discount")


@register("SELECT * FROM events WHERE length(replace(event_type, 'error', '')) > 0")
def filter_truthy_text(spark, folder):
    return filter_rows(table(spark, folder, "events"), bf.replace("event_type", "error", ""))


@register("SELECT *, trunc(l_extendedprice * (1 - l_discount))::INTEGER AS net FROM lineitem")
def create_field_int(spark, folder):
    return create_field(table(spark, folder, "lineitem"), "net", "l_extendedprice * (1 - l_discount)", "int")


@register("SELECT *, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def create_field_double(spark, folder):
    return create_field(table(spark, folder, "lineitem"), "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "double")


@register("SELECT *, l_tax <> 0 AS taxed, length(l_returnflag) > 0 AS flagged FROM lineitem")
def create_field_bool(spark, folder):
    taxed = create_field(table(spark, folder, "lineitem"), "taxed", "l_tax", "bool")
    return create_field(taxed, "flagged", "l_returnflag", "bool")


@register(
    """SELECT *, (o_totalprice * 1e12)::VARCHAR AS large, (o_totalprice / 1e12)::VARCHAR AS small,
              CASE WHEN o_totalprice > 250000 THEN 'True' ELSE 'False' END AS expensive,
              coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, 'None') AS finished
       FROM orders"""
)
def create_field_text(spark, folder):
    """str() of floats in scientific and positional form, of booleans, and of missing values."""
    df = create_field(table(spark, folder, "orders"), "large", "o_totalprice * 1e12D", "string")
    df = create_field(df, "small", "o_totalprice / 1e12D", "string")
    df = create_field(df, "expensive", "o_totalprice > 250000", "string")
    return create_field(df, "finished", "if(o_orderstatus = 'F', o_orderpriority, null)", "string")


@register(
    """SELECT c_custkey, split_part(c_name, '#', 2)::INTEGER AS number,
              (c_custkey::VARCHAR || '000.5')::DOUBLE AS thousands FROM customer"""
)
def cast_text_to_number(spark, folder):
    """int() and float() accept surrounding blanks and single underscores between digits."""
    customers = table(spark, folder, "customer")
    df = create_field(customers, "number", "concat(' ', split_part(c_name, '#', 2), '\n')", "int")
    df = create_field(df, "thousands", "concat(c_custkey, '_000.5')", "double")
    return df.select("c_custkey", "number", "thousands")


@register(
    """SELECT o_orderkey, o_custkey, o_orderstatus, trunc(o_totalprice / 1000) AS o_totalprice, o_orderdate,
              o_orderpriority FROM orders"""
)
def change_field_value(spark, folder):
    """Keeps the present type: the integral result is stored as a double again."""
    return change_field(table(spark, folder, "orders"), "o_totalprice", "cast(o_totalprice / 1000 as int)")


@register(
    """SELECT p_partkey, p_name, p_brand, p_type, (p_size * 2)::VARCHAR AS p_size,
              trunc(p_retailprice)::INTEGER AS p_retailprice FROM part"""
)
def change_field_type(spark, folder):
    df = change_field(table(spark, folder, "part"), "p_size", "p_size * 2", "string")
    return change_field(df, "p_retailprice", "p_retailprice", "int")


@register("SELECT * EXCLUDE (c_acctbal) FROM customer")
def delete_one_field(spark, folder):
    return delete_field(table(spark, folder, "customer"), "c_acctbal")


# --- expressions


@register(
    r"""SELECT c_custkey, string_split(c_name, '#')[1] AS head, string_split(c_name, '#')[-1] AS last,
               string_split(c_name, '#')[5] AS absent,
               regexp_replace(' ' || chr(9) || c_mktsegment || ' ' || chr(10), '^\s+|\s+$', '', 'g') AS stripped,
               substr(c_name, 1, 8) AS front, right(c_name, 4) AS back, substr(c_name, 3, length(c_name) - 5) AS middle,
               contains(c_name, '#0') AS has_zero, replace(c_name, '0', 'o') AS replaced,
               upper(c_mktsegment) AS upper, lower(c_mktsegment) AS lower, length(c_name) AS length,
               starts_with(c_name, 'Cust') AS starts, c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed,
               c_name || ':' || c_mktsegment AS joined
        FROM customer"""
)
def text_expressions(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey",
        bf.split_get("c_name", "#", 0).alias("head"),
        bf.split_get("c_name", "#", -1).alias("last"),
        bf.split_get("c_name", "#", 4).alias("absent"),
        bf.strip(F.concat(F.lit(" \t"), F.col("c_mktsegment"), F.lit(" \n"))).alias("stripped"),
        bf.slice_text("c_name", stop=8).alias("front"),
        bf.slice_text("c_name", start=-4).alias("back"),
        bf.slice_text("c_name", 2, -3).alias("middle"),
        bf.contains("c_name", "'#0'").alias("has_zero"),
        bf.replace("c_name", "0", "o").alias("replaced"),
        F.upper("c_mktsegment").alias("upper"),
        F.lower("c_mktsegment").alias("lower"),
        F.length("c_name").cast("bigint").alias("length"),
        F.startswith("c_name", F.lit("Cust")).alias("starts"),
        F.expr("c_mktsegment in ('BUILDING', 'MACHINERY')").alias("listed"),
        F.expr("concat(c_name, ':', c_mktsegment)").alias("joined"),
    )


@register(
    """WITH n AS (SELECT *, o_custkey - 700 AS a, CASE WHEN o_orderstatus = 'F' THEN 7 ELSE -7 END::BIGINT AS b,
                         o_totalprice - 250000 AS x FROM orders),
            m AS (SELECT *, ((a % b) + b) % b AS r, fmod(x, 1000.5) AS f FROM n),
            k AS (SELECT *, CASE WHEN f < 0 THEN f + 1000.5 ELSE f END AS g FROM m)
       SELECT o_orderkey, r AS rest, (a - r) // b AS quotient, g AS float_rest, floor((x - g) / 1000.5 + 0.5) AS float_quotient,
              round_even(a / 2, 0) + 0.0 AS half, abs(a) AS size, greatest(a, b) AS larger, least(a, b) AS smaller,
              a / 2 AS ratio
       FROM k"""
)
def number_expressions(spark, folder):
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey - 700L as a", "if(o_orderstatus = 'F', 7L, -7L) as b", "o_totalprice - 250000 as x"
    )
    return orders.select(
        "o_orderkey",
        bf.modulo("a", "b").alias("rest"),
        bf.floor_div(orders, "a", "b").alias("quotient"),
        bf.modulo("x", "1000.5D").alias("float_rest"),
        bf.floor_div(orders, "x", "1000.5D").alias("float_quotient"),
        bf.round_half_even("a / 2").alias("half"),
        F.abs("a").alias("size"),
        F.greatest("a", "b").alias("larger"),
        F.least("a", "b").alias("smaller"),
        F.expr("a / 2").alias("ratio"),
    )


@register(
    """WITH n AS (SELECT *, CASE WHEN event_type <> 'error' THEN value - 20 END AS v,
                         CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS t FROM events)
       SELECT event_id, v IS NOT DISTINCT FROM NULL AS missing,
              coalesce(v <> 0, false) AND t <> '' AS both_set, coalesce(v <> 0, false) OR t <> '' AS any_set,
              NOT coalesce(v <> 0, false) AS unset, CASE WHEN t <> '' THEN t ELSE props END AS first_set,
              CASE WHEN t <> '' THEN props ELSE t END AS last_set, value BETWEEN 10 AND 20 AS chained,
              CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS level
       FROM n"""
)
def logic_expressions(spark, folder):
    events = table(spark, folder, "events").selectExpr(
        "*", "if(event_type <> 'error', value - 20, null) as v", "if(event_type = 'view', '', event_type) as t"
    )
    return events.select(
        "event_id",
        bf.equals("v", "null").alias("missing"),
        bf.all_truthy(events, "v", "t").alias("both_set"),
        bf.any_truthy(events, "v", "t").alias("any_set"),
        bf.not_truthy(events, "v").alias("unset"),
        bf.first_truthy(events, "t", "props").alias("first_set"),
        bf.last_truthy(events, "t", "props").alias("last_set"),
        F.expr("10 <= value and value <= 20").alias("chained"),
        F.expr("if(value > 50, 'high', 'low')").alias("level"),
    )


@register("SELECT *, value * 1.5 + 1 AS scaled FROM events")
def python_function(spark, folder):
    """The escape hatch: a vectorised Python function over one field."""
    events = table(spark, folder, "events")
    return create_field(events, "scaled", bf.from_python(lambda value: value * 1.5 + 1, "double", "value"), "double")


# --- enrichment


@register(
    """SELECT e.*, coalesce(c.c_name, '') AS customer FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id"""
)
def enrich_all(spark, folder):
    return enrich(table(spark, folder, "events"), customer_names(spark, folder), "customer", "user_id")


@register(
    """SELECT o.*, coalesce(c.c_name, '') AS customer FROM orders o
       LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'"""
)
def enrich_with_misses(spark, folder):
    return enrich(table(spark, folder, "orders"), customer_names(spark, folder, "BUILDING"), "customer", "o_custkey")


@register(
    """SELECT e.*, coalesce(l.price, '') AS last_price FROM events e LEFT JOIN
       (SELECT o_custkey, arg_max(o_totalprice, o_orderkey)::VARCHAR AS price FROM orders GROUP BY o_custkey) l
       ON l.o_custkey = e.user_id"""
)
def enrich_last_written(spark, folder):
    """Keys written several times: the last entry counts."""
    prices = lookup_table(table(spark, folder, "orders"), "o_custkey", "o_totalprice", version="o_orderkey")
    return enrich(table(spark, folder, "events"), prices, "last_price", "user_id")


@register(
    """SELECT e.*, coalesce(c.c_name, '') AS customer FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id"""
)
def enrich_stream(spark, folder):
    enriched = enrich(stream(spark, folder, "events"), customer_names(spark, folder), "customer", "user_id")
    return finished(spark, enriched, "enrich")


# --- deduplication

DEDUP_EVENTS = """
    WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    a AS (SELECT * FROM f WHERE rn = 1
          UNION ALL
          SELECT n.* FROM a, LATERAL (
              SELECT f.* FROM f WHERE f.user_id = a.user_id AND f.ts > a.ts + INTERVAL 86400 SECOND ORDER BY rn LIMIT 1) n)
    SELECT * EXCLUDE (rn) FROM a"""


@register(DEDUP_EVENTS)
def dedup_events(spark, folder):
    return dedup(table(spark, folder, "events"), "user_id", DAY, "ts", ["event_id"])


@register(DEDUP_EVENTS)
def dedup_events_in_ranges(spark, folder):
    """The way taken by hot keys, here for the users with the most events."""
    events = table(spark, folder, "events")
    return dedup(events, "user_id", DAY, "ts", ["event_id"], group_rows=hottest(events, "user_id"))


def last_purchases(events: DataFrame) -> DataFrame:
    """Changelog: the latest purchase of each user; one entry per user and time."""
    bought = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return bought.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), "ts")


AS_OF_SQL = """
    WITH c AS (SELECT user_id, ts, max(event_id)::VARCHAR AS bought FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts),
    v AS (SELECT * FROM events WHERE event_type <> 'purchase')
    SELECT v.*, coalesce(c.bought, '') AS bought FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.ts >= c.ts"""


@register(AS_OF_SQL)
def enrich_as_of(spark, folder):
    """Every event with the purchase that its user had made last at that time."""
    events = table(spark, folder, "events")
    return as_of(events.filter("event_type <> 'purchase'"), last_purchases(events), "bought", "user_id")


@register(AS_OF_SQL)
def enrich_as_of_in_ranges(spark, folder):
    """The same by the way of hot keys, for the users with the most events."""
    events = table(spark, folder, "events")
    return as_of(events.filter("event_type <> 'purchase'"), last_purchases(events), "bought", "user_id", group_rows=hottest(events, "user_id"))


@register(AS_OF_SQL)
def enrich_as_of_stream(spark, folder):
    events = table(spark, folder, "events")
    path = scratch_path(spark, "purchases")
    last_purchases(events).write.parquet(path)
    changes = file_records(spark, path, last_purchases(events).schema, "parquet", streaming=True)
    views = stream(spark, folder, "events").filter("event_type <> 'purchase'")
    return finished(spark, as_of(views, changes, "bought", "user_id"), "as-of")


@register(
    """
    WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
    a AS (SELECT * FROM f WHERE rn = 1
          UNION ALL
          SELECT n.* FROM a, LATERAL (
              SELECT f.* FROM f WHERE f.event_type = a.event_type AND f.ts > a.ts + INTERVAL 3600 SECOND
              ORDER BY rn LIMIT 1) n)
    SELECT * EXCLUDE (rn) FROM a"""
)
def dedup_hot_keys(spark, folder):
    """Five keys, each with about a fifth of all rows, split into ranges of time."""
    events = table(spark, folder, "events")
    return dedup(events, "event_type", HOUR, "ts", ["event_id"], group_rows=share(events, 20))


@register(DEDUP_EVENTS)
def dedup_events_stream(spark, folder):
    kept = dedup(stream_in_parts(spark, folder, "events", "ts"), "user_id", DAY, "ts", ["event_id"], lateness="1 day")
    return finished(spark, kept, "dedup")


@register(
    """
    WITH thirds AS (SELECT *, CAST(floor(3 * event_id / (SELECT max(event_id) + 1 FROM events)) AS INT) AS third FROM events)
    SELECT 'late_rows' AS counter, count(*) AS n
    FROM thirds WHERE third = 0 AND ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM thirds WHERE third = 1) - INTERVAL 1 HOUR
    """
)
def dedup_late_rows(spark, folder):
    """Rows behind the watermark, as counted while a stream runs: the first third of the events arrives after the other two."""
    events, path = table(spark, folder, "events"), scratch_path(spark, "late")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = events.agg(F.max("event_id") + 1).first()[0]
    for third in (1, 2, 0):  # the watermark of a micro-batch counts for the rows after the next one
        part = events.filter(F.floor(3 * F.col("event_id") / F.lit(ids)) == third)
        part.repartition(files).write.mode("append").parquet(path)
    arriving = file_records(spark, path, events.schema, "parquet", streaming=True, files_per_trigger=files)
    kept = dedup(arriving, "user_id", DAY, "ts", ["event_id"], lateness="1 hour")
    out = scratch_path(spark, "late-out")
    writer = kept.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return counter_rows(spark, query_totals(query, late=True))


@register(DEDUP_EVENTS)
def dedup_events_resumed(spark, folder):
    """The earlier half by one query; the rest by one that takes over its state and its place, with more state partitions."""
    events, source, name = table(spark, folder, "events"), scratch_path(spark, "arriving"), "spark.sql.shuffle.partitions"
    before, state, after, results = spark.conf.get(name), None, None, []
    try:
        for turn, part in enumerate(time_parts(events, "ts", 2)):
            part.write.mode("append").parquet(source)
            spark.conf.set(name, int(before) + 3 * turn)
            records, path = file_records(spark, source, events.schema, "parquet", streaming=True, after=after), scratch_path(spark, "turn")
            kept = dedup(records, "user_id", DAY, "ts", ["event_id"], lateness="1 day", state=state)
            results.append(finished(spark, kept, "turn", path))
            state, after = kept_state(spark, f"{path}/progress"), files_read(spark, f"{path}/progress")
    finally:
        spark.conf.set(name, before)
    return reduce(DataFrame.unionAll, results)


@register(
    """
    WITH RECURSIVE f AS (SELECT *, row_number() OVER (
        PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem),
    a AS (SELECT * FROM f WHERE rn = 1
          UNION ALL
          SELECT n.* FROM a, LATERAL (
              SELECT f.* FROM f WHERE f.l_suppkey = a.l_suppkey AND f.l_shipdate > a.l_shipdate + INTERVAL 30 DAY
              ORDER BY rn LIMIT 1) n)
    SELECT * EXCLUDE (rn) FROM a"""
)
def dedup_shipments(spark, folder):
    """Many rows of a key at the same instant."""
    return dedup(
        table(spark, folder, "lineitem"), "l_suppkey", MONTH, "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey"]
    )


# --- pairing


def pair_sql(select: str, source: str = "events", head: str = "WITH") -> str:
    """Views (main side, sorted first) with purchases of the same user."""
    return f"""{head}
    m AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS side FROM {source}
          WHERE event_type IN ('view', 'purchase')),
    l AS (SELECT *, lag(side) OVER w AS ps, lag(ts) OVER w AS pt, lag(event_id) OVER w AS pid
          FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, side, event_id)),
    k AS (SELECT *, coalesce(side <> ps AND ts <= pt + INTERVAL 1 DAY, false) AS link FROM l),
    i AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (
              PARTITION BY user_id ORDER BY ts, side, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM k),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY ts, side, event_id) - 1 AS pos FROM i),
    pairs AS (SELECT CASE side WHEN 0 THEN event_id ELSE pid END AS first_id,
                     CASE side WHEN 0 THEN pid ELSE event_id END AS second_id FROM p WHERE link AND pos % 2 = 1)
    SELECT {select} FROM pairs JOIN events v ON v.event_id = first_id JOIN events b ON b.event_id = second_id"""


def pair_shipments_sql(key: str) -> str:
    """Returned (main side) with unreturned shipments, as rows k, a, b of ``pairs``."""
    return f"""
    WITH m AS (SELECT {key} AS k, l_shipdate AS t, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS side,
                      l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_returnflag IN ('R', 'N')),
    l AS (SELECT *, lag(side) OVER w AS ps, lag(t) OVER w AS pt, lag(o) OVER w AS po, lag(n) OVER w AS pn, lag(p) OVER w AS pp
          FROM m WINDOW w AS (PARTITION BY k ORDER BY t, side, o, n, p)),
    j AS (SELECT *, coalesce(side <> ps AND t <= pt + INTERVAL 2 DAY, false) AS link FROM l),
    i AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (
              PARTITION BY k ORDER BY t, side, o, n, p ROWS UNBOUNDED PRECEDING) AS isl FROM j),
    q AS (SELECT *, row_number() OVER (PARTITION BY k, isl ORDER BY t, side, o, n, p) - 1 AS pos FROM i),
    pairs AS (SELECT k, CASE side WHEN 0 THEN {{r: t, o: o, n: n, p: p}} ELSE {{r: pt, o: po, n: pn, p: pp}} END AS a,
                     CASE side WHEN 0 THEN {{r: pt, o: po, n: pn, p: pp}} ELSE {{r: t, o: o, n: n, p: p}} END AS b
              FROM q WHERE link AND pos % 2 = 1)"""


SHIPMENT = ["l_orderkey", "l_linenumber", "l_partkey"]


def shipments(items: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    returned = items.filter("l_returnflag = 'R'").select(key, "l_shipdate", *SHIPMENT)
    kept = items.filter("l_returnflag = 'N'").select(
        key, "l_shipdate", *SHIPMENT, F.col("l_orderkey").alias("other_order"), F.col("l_partkey").alias("other_part")
    )
    return returned, kept


PAIR_EVENTS = pair_sql("v.*, b.user_id AS buyer, b.value AS paid")


def sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Views, and purchases with differently named key and value."""
    purchases = events.filter("event_type = 'purchase'")
    return events.filter("event_type = 'view'"), purchases.select(
        "event_id", "ts", F.col("user_id").alias("buyer"), F.col("value").alias("paid")
    )


@register(PAIR_EVENTS)
def pair_events(spark, folder):
    return pair_join(*sides(table(spark, folder, "events")), "user_id", "buyer", DAY, "ts", ["event_id"])


@register(PAIR_EVENTS)
def pair_events_in_ranges(spark, folder):
    """The way taken by hot keys, here for the users with the most views and purchases."""
    views, purchases = sides(table(spark, folder, "events"))
    rows = hottest(views.select("user_id").unionAll(purchases.select("buyer")), "user_id")
    return pair_join(views, purchases, "user_id", "buyer", DAY, "ts", ["event_id"], group_rows=rows)


@register(
    pair_shipments_sql("l_linestatus")
    + """
    SELECT k AS l_linestatus, a.r AS l_shipdate, a.o AS l_orderkey, a.n AS l_linenumber, a.p AS l_partkey,
           b.o AS other_order, b.p AS other_part FROM pairs"""
)
def pair_hot_keys(spark, folder):
    """Two keys, each with about a third of all rows, split into ranges of time."""
    returned, kept = shipments(table(spark, folder, "lineitem"), "l_linestatus")
    rows = share(returned, 20)
    return pair_join(
        returned, kept, "l_linestatus", "l_linestatus", 2 * DAY, "l_shipdate", SHIPMENT, group_rows=rows
    )


@register(PAIR_EVENTS)
def pair_events_stream(spark, folder):
    pairs = pair_join(
        *sides(stream_in_parts(spark, folder, "events", "ts")), "user_id", "buyer", DAY, "ts", ["event_id"], lateness="1 day"
    )
    return finished(spark, pairs, "pair")


@register(pair_sql("v.*"))
def pair_events_same_names(spark, folder):
    """Both sides have the same field names: the main side's values are kept."""
    events = table(spark, folder, "events")
    views, purchases = events.filter("event_type = 'view'"), events.filter("event_type = 'purchase'")
    return pair_join(views, purchases, "user_id", "user_id", DAY, "ts", ["event_id"])


@register(
    pair_shipments_sql("l_suppkey")
    + """
    SELECT k AS l_suppkey, a.r AS l_shipdate, a.o AS l_orderkey, a.n AS l_linenumber, a.p AS l_partkey,
           b.o AS other_order, b.p AS other_part FROM pairs"""
)
def pair_shipments(spark, folder):
    """Returned with unreturned shipments of a supplier; many rows at the same instant."""
    returned, kept = shipments(table(spark, folder, "lineitem"), "l_suppkey")
    return pair_join(returned, kept, "l_suppkey", "l_suppkey", 2 * DAY, "l_shipdate", SHIPMENT)


# --- sources and sinks


@register("SELECT event_id, json_extract(props, '$.k')::INTEGER AS k, NULL::VARCHAR AS absent FROM events")
def json_source(spark, folder):
    """Declared fields of a JSON column; a field the record lacks is null."""
    events = table(spark, folder, "events").select("event_id", "props")
    return decode_json(events, {"k": "int", "absent": "string"}, "props")


@register(
    """SELECT event_id::INTEGER AS event_id, event_type, value, user_id::INTEGER AS user_id, ts AS _time,
              0 AS _partition, event_id AS _offset FROM events"""
)
def topic_source(spark, folder):
    """Decoding of topic rows: the events in the shape the Kafka connector delivers."""
    events = table(spark, folder, "events")
    raw = events.select(
        F.to_json(F.struct("event_id", "event_type", "value", "user_id")).cast("binary").alias("value"),
        F.col("ts").alias("timestamp"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
    )
    fields = {"event_id": "int", "event_type": "string", "value": "double", "user_id": "int"}
    return topic_records(raw, fields)


@register(
    """SELECT '{"c_acctbal":' || c_acctbal::VARCHAR || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment
              || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS value FROM customer"""
)
def topic_sink_rows(spark, folder):
    """What goes to a topic: one JSON object per row, fields in alphabetical order."""
    return json_value(table(spark, folder, "customer"))


@register("SELECT event_type AS kind, event_id AS number, value AS amount FROM events")
def warehouse_sink_rows(spark, folder):
    """What goes to a warehouse table: renamed, and in the order of the field names."""
    columns = {"event_id": "number", "value": "amount", "event_type": "kind"}
    return table_columns(table(spark, folder, "events"), columns)


@register("SELECT * FROM events")
def bucket_sink_round_trip(spark, folder):
    """Written as JSON, one folder per event type, and read back whole."""
    events, path = table(spark, folder, "events"), scratch_path(spark, "buckets")
    write_buckets(events, path, "event_type", gather=True)
    return read_buckets(spark, path, events.schema)


@register("SELECT * FROM events")
def bucket_stream_round_trip(spark, folder):
    events, path = stream(spark, folder, "events"), scratch_path(spark, "bucket-stream")
    writer = bucket_stream(events, f"{path}/rows", "event_type").option("checkpointLocation", f"{path}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return read_buckets(spark, f"{path}/rows", events.schema)


# --- whole jobs

EVENT_FIELDS = {"event_id": "int", "event_type": "string", "user_id": "int", "value": "double"}


def event_records(df: DataFrame) -> Records:
    return Records(df, "ts", ["event_id"])


def kafka_source() -> dict:
    return {"source_type": "kafka", "address": "broker:9092", "topic": "events", "schema": EVENT_FIELDS}


def topic_target(topic: str) -> dict:
    return {"sink_type": "kafka", "address": "broker:9092", "topic": topic}


CHAIN_JOB = {
    "settings": {"checkpoint_interval": 30000},
    "sources": {"events": kafka_source()},
    "sinks": {"out": topic_target("daily")},
    "operators": {
        "events": [
            {"operator_type": "filter", "expression": "item['value'] > 20"},
            {"operator_type": "deduplicator", "key": "user_id", "time": DAY},
            {"operator_type": "field_enricher", "field_name": "customer", "search_key": "item['user_id']"},
            {"operator_type": "filter", "expression": "item['customer'] != ''"},
            {"operator_type": "field_creator", "field_name": "cents", "value": "py_round(value * 100)", "field_type": "int"},
            {"operator_type": "field_changer", "field_name": "value", "value": "value * 2"},
            {"operator_type": "field_deleter", "field_name": "event_type"},
            {"operator_type": "output", "sink": "out"},
        ]
    },
}

CHAIN_ANCHORS = """
    WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
                         FROM events WHERE value > 20),
    a AS (SELECT * FROM f WHERE rn = 1
          UNION ALL
          SELECT n.* FROM a, LATERAL (
              SELECT f.* FROM f WHERE f.user_id = a.user_id AND f.ts > a.ts + INTERVAL 86400 SECOND ORDER BY rn LIMIT 1) n)"""

CHAIN_SQL = CHAIN_ANCHORS + """
    SELECT event_id::INTEGER AS event_id, user_id::INTEGER AS user_id, value * 2 AS value, c_name AS customer,
           round(value * 100)::INTEGER AS cents
    FROM a JOIN customer ON c_custkey = user_id AND c_mktsegment IN ('BUILDING', 'MACHINERY')"""


def chain_lookup(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").filter("c_mktsegment in ('BUILDING', 'MACHINERY')")
    return lookup_table(customers, "c_custkey", "c_name")


@register(CHAIN_SQL)
def job_chain(spark, folder):
    inputs = {"events": event_records(table(spark, folder, "events"))}
    return build_job(spark, CHAIN_JOB, inputs, chain_lookup(spark, folder), streaming=False).outputs[0].rows


@register(CHAIN_SQL)
def job_chain_stream(spark, folder):
    """The same job as streaming queries, from the source to a table."""
    inputs = {"events": event_records(stream(spark, folder, "events"))}
    lookup = chain_lookup(spark, folder)
    schema = build_job(spark, CHAIN_JOB, {"events": event_records(table(spark, folder, "events"))}, lookup, streaming=False).outputs[0].rows.schema
    path, write = batch_folders(spark, "chain")
    name = work_path(spark, "chain").rsplit("/", 1)[1]
    start_job(spark, CHAIN_JOB, name, inputs, lookup, Targets({"out": write}), lateness="1 day", available_now=True)
    return read_batches(spark, path, schema)


CLONE_JOB = {
    "sources": {"events": kafka_source(), "costly": {"source_type": "clone", "source": "events"}},
    "sinks": {"all": topic_target("all"), "costly": topic_target("costly")},
    "operators": {
        "events": [
            {"operator_type": "field_creator", "field_name": "branch", "value": "'all'", "field_type": "string"},
            {"operator_type": "clone", "clone_name": "costly"},
            {"operator_type": "filter", "expression": "event_type != 'error'"},
            {"operator_type": "output", "sink": "all"},
        ],
        "costly": [
            {"operator_type": "filter", "expression": "value > 50"},
            {"operator_type": "field_changer", "field_name": "branch", "value": "'costly'"},
            {"operator_type": "output", "sink": "costly"},
        ],
    },
}


@register(
    """WITH e AS (SELECT event_id::INTEGER AS event_id, event_type, user_id::INTEGER AS user_id, value FROM events)
       SELECT *, 'all' AS branch FROM e WHERE event_type <> 'error'
       UNION ALL SELECT *, 'costly' FROM e WHERE value > 50"""
)
def job_clone(spark, folder):
    """Two outputs of one source; the clone branches off before the second filter."""
    inputs = {"events": event_records(table(spark, folder, "events"))}
    first, second = build_job(spark, CLONE_JOB, inputs, streaming=False).outputs
    return first.rows.unionByName(second.rows)


JOIN_JOB = {
    "sources": {"events": kafka_source(), "purchases": {"source_type": "clone", "source": "events"}},
    "sinks": {"out": topic_target("pairs")},
    "operators": {
        "events": [
            {"operator_type": "clone", "clone_name": "purchases"},
            {"operator_type": "filter", "expression": "event_type = 'view'"},
            {
                "operator_type": "stream_joiner", "first_key": "user_id", "second_key": "buyer",
                "second_source": "purchases", "time": DAY,
            },
            {"operator_type": "output", "sink": "out"},
        ],
        "purchases": [
            {"operator_type": "filter", "expression": "event_type = 'purchase'"},
            {"operator_type": "field_creator", "field_name": "buyer", "value": "user_id", "field_type": "int"},
            {"operator_type": "field_creator", "field_name": "paid", "value": "value", "field_type": "double"},
            {"operator_type": "stream_joiner_plug", "main_source": "events"},
        ],
    },
}


@register(
    pair_sql(
        "v.event_id::INTEGER AS event_id, v.event_type, v.user_id::INTEGER AS user_id, v.value,"
        " b.user_id::INTEGER AS buyer, b.value AS paid"
    )
)
def job_join(spark, folder):
    """A stream joined with a clone of itself."""
    inputs = {"events": event_records(table(spark, folder, "events"))}
    return build_job(spark, JOIN_JOB, inputs, streaming=False).outputs[0].rows


STATEFUL_JOB = {
    **JOIN_JOB,
    "sinks": {"out": topic_target("pairs"), "kept": topic_target("kept")},
    "operators": {
        **JOIN_JOB["operators"],
        "events": [
            {"operator_type": "filter", "expression": "value > 20"},
            {"operator_type": "deduplicator", "key": "user_id", "time": HOUR},
            {"operator_type": "output", "sink": "kept"},
            *JOIN_JOB["operators"]["events"],
        ],
    },
}


@register(
    pair_sql(
        "v.event_id::INTEGER AS event_id, v.event_type, v.user_id::INTEGER AS user_id, v.value,"
        " b.user_id::INTEGER AS buyer, b.value AS paid",
        source="a",
        head=CHAIN_ANCHORS.replace("86400", "3600") + ",",
    )
)
def job_two_stateful_steps(spark, folder):
    """Deduplicated, stored, then joined with a clone of itself."""
    path = scratch_path(spark, "pairs")
    inputs = {"events": event_records(table(spark, folder, "events"))}
    writers = {
        "out": lambda df, _: df.write.parquet(path),
        "kept": lambda df, _: df.write.format("noop").mode("overwrite").save(),
    }
    run_batch(spark, STATEFUL_JOB, inputs, targets=Targets(writers))
    return spark.read.parquet(path)


@register(
    CHAIN_ANCHORS
    + """,
    known AS (SELECT a.* FROM a JOIN customer ON c_custkey = user_id AND c_mktsegment IN ('BUILDING', 'MACHINERY'))
    SELECT '[events:0] filter_in' AS counter, count(*) AS n FROM events
    UNION ALL SELECT '[events:0] filter_out', count(*) FROM f
    UNION ALL SELECT '[events:1] deduplicator_in', count(*) FROM f
    UNION ALL SELECT '[events:1] deduplicator_out', count(*) FROM a
    UNION ALL SELECT '[events:2] enricher_in', count(*) FROM a
    UNION ALL SELECT '[events:2] enrichment_count', count(*) FROM known
    UNION ALL SELECT '[events:3] filter_in', count(*) FROM a
    UNION ALL SELECT '[events:3] filter_out', count(*) FROM known"""
)
def job_counters(spark, folder):
    """Operator counters, counted by the job itself while it runs."""
    shared_dir(spark)
    inputs = {"events": event_records(table(spark, folder, "events"))}
    drop = Targets({"out": lambda df, _: df.write.format("noop").mode("overwrite").save()})
    built = run_batch(spark, CHAIN_JOB, inputs, chain_lookup(spark, folder), drop)
    return spark.createDataFrame(sorted(built.counters.batch_values().items()), "counter string, n bigint")


EXPRESSION_JOB = {
    "sources": {"orders": {"source_type": "kafka", "address": "broker:9092", "topic": "orders", "schema": {
        "o_orderkey": "int", "o_custkey": "int", "o_totalprice": "double", "o_orderpriority": "string", "o_orderstatus": "string"}}},
    "sinks": {"out": topic_target("out")},
    "operators": {
        "orders": [
            {"operator_type": "field_creator", "field_name": "rest", "value": "py_mod(item['o_custkey'] - 700, -7)", "field_type": "int"},
            {"operator_type": "field_creator", "field_name": "whole", "value": "py_floordiv(o_custkey - 700, 7)", "field_type": "int"},
            {"operator_type": "field_creator", "field_name": "half", "value": "py_round(o_custkey / 2)", "field_type": "int"},
            {"operator_type": "field_creator", "field_name": "level", "value": "py_split(item['o_orderpriority'], '-', 0)", "field_type": "string"},
            {"operator_type": "field_creator", "field_name": "middle", "value": "py_slice(o_orderpriority, 2, -1)", "field_type": "string"},
            {"operator_type": "field_creator", "field_name": "state", "value": "py_or(replace(o_orderstatus, 'O', ''), 'none')", "field_type": "string"},
            {"operator_type": "field_enricher", "field_name": "customer", "search_key": "py_split(concat('c:', o_custkey), ':', -1)"},
            {"operator_type": "filter", "expression": "py_in('1', item['customer']) or truthy(rest)"},
            {"operator_type": "output", "sink": "out"},
        ]
    },
}


@register(
    """WITH n AS (SELECT o_orderkey::INTEGER AS o_orderkey, o_custkey::INTEGER AS o_custkey, o_orderpriority, o_orderstatus, o_totalprice,
                         coalesce(c_name, '') AS customer, ((o_custkey - 700) % 7 + 7) % 7 AS m
                  FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment IN ('BUILDING', 'MACHINERY')),
            r AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE m - 7 END::INTEGER AS rest FROM n)
       SELECT customer, round_even(o_custkey / 2, 0)::INTEGER AS half, trim(string_split(o_orderpriority, '-')[1], '') AS level,
              substr(o_orderpriority, 3, greatest(length(o_orderpriority) - 3, 0)) AS middle, o_custkey, o_orderkey, o_orderpriority, o_orderstatus,
              o_totalprice, rest, CASE WHEN replace(o_orderstatus, 'O', '') = '' THEN 'none' ELSE replace(o_orderstatus, 'O', '') END AS state,
              ((o_custkey - 700 - m) // 7)::INTEGER AS whole
       FROM r WHERE contains(customer, '1') OR rest <> 0"""
)
def job_expressions(spark, folder):
    """Python's meaning in a declared job: negative remainders, halves, split search keys, slices."""
    orders = table(spark, folder, "orders")
    inputs = {"orders": Records(orders, "o_orderdate", ["o_orderkey"])}
    return build_job(spark, EXPRESSION_JOB, inputs, chain_lookup(spark, folder), streaming=False).outputs[0].rows


PYTHON_JOB = {
    "sources": {"orders": {"source_type": "kafka", "address": "broker:9092", "topic": "orders", "schema": {
        "o_orderkey": "int", "o_custkey": "int", "o_totalprice": "double", "o_orderpriority": "string", "o_orderstatus": "string"}}},
    "sinks": {"out": topic_target("out")},
    "operators": {
        "orders": [
            {"operator_type": "filter", "expression": "item['o_custkey'] % 3 and item['o_orderstatus'] in ('O', 'F') and not item['o_totalprice'] < 1000"},
            {"operator_type": "field_creator", "field_name": "level", "value": "int(item['o_orderpriority'].split('-')[0]) + 1", "field_type": "int"},
            {"operator_type": "field_creator", "field_name": "word", "value": "item['o_orderpriority'].split('-')[-1].lower()[:-2]", "field_type": "string"},
            {"operator_type": "field_creator", "field_name": "share", "value": "round(item['o_totalprice'] / 7, 2)", "field_type": "double"},
            {"operator_type": "field_creator", "field_name": "band", "value": "'top' if 300000 < item['o_totalprice'] <= 400000 else item['word'].replace('s', '') or 'none'", "field_type": "string"},
            {"operator_type": "field_creator", "field_name": "even", "value": "item['o_orderkey'] % 2 == 0", "field_type": "bool"},
            {"operator_type": "field_changer", "field_name": "o_custkey", "value": "(700 - item['o_custkey']) // 7"},
            {"operator_type": "field_enricher", "field_name": "customer", "search_key": "'c:' + str(abs(item['o_custkey'])) if item['even'] else str(item['o_orderkey'] % 100)"},
            {"operator_type": "filter", "expression": "item['customer'] != '' or len(item['band']) > 3"},
            {"operator_type": "output", "sink": "out"},
        ]
    },
}


@register(
    """WITH f AS (SELECT o_orderkey::INTEGER AS o_orderkey, o_custkey AS c, o_totalprice, o_orderpriority, o_orderstatus, string_split(o_orderpriority, '-') AS p
                  FROM orders WHERE o_custkey % 3 <> 0 AND o_orderstatus IN ('O', 'F') AND o_totalprice >= 1000),
            n AS (SELECT *, p[1]::INTEGER + 1 AS level, lower(p[-1])[1 : greatest(len(p[-1]) - 2, 0)] AS word, o_orderkey % 2 = 0 AS even,
                         ((700 - c - (((700 - c) % 7 + 7) % 7)) // 7)::INTEGER AS o_custkey FROM f),
            b AS (SELECT *, CASE WHEN 300000 < o_totalprice AND o_totalprice <= 400000 THEN 'top'
                                 WHEN replace(word, 's', '') <> '' THEN replace(word, 's', '') ELSE 'none' END AS band FROM n)
       SELECT band, coalesce(c_name, '') AS customer, even, level, b.o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice,
              round(o_totalprice / 7, 2) AS share, word
       FROM b LEFT JOIN customer ON c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT even AND c_custkey = o_orderkey % 100
       WHERE coalesce(c_name, '') <> '' OR length(band) > 3"""
)
def job_python_expressions(spark, folder):
    """A job whose expressions are Python texts about the record, split search keys and chained comparisons included."""
    orders = table(spark, folder, "orders")
    inputs = {"orders": Records(orders, "o_orderdate", ["o_orderkey"])}
    return build_job(spark, PYTHON_JOB, inputs, chain_lookup(spark, folder), streaming=False).outputs[0].rows


# --- counters of joiners and of several outputs

COUNTED_JOB = {
    **JOIN_JOB,
    "sinks": {"out": topic_target("pairs"), "views": topic_target("views"), "late": topic_target("late")},
    "operators": {
        **JOIN_JOB["operators"],
        "events": [
            JOIN_JOB["operators"]["events"][0],
            JOIN_JOB["operators"]["events"][1],
            {"operator_type": "output", "sink": "views"},
            {"operator_type": "filter", "expression": "value > 50"},
            {"operator_type": "output", "sink": "late"},
            JOIN_JOB["operators"]["events"][2],
            {"operator_type": "output", "sink": "out"},
        ],
    },
}

COUNTED_SQL = pair_sql("count(*) AS n", source="v", head="WITH v AS (SELECT * FROM events WHERE event_type <> 'view' OR value > 50),")
COUNTED_SQL = f"""
    SELECT '[events:1] filter_in' AS counter, count(*) AS n FROM events
    UNION ALL SELECT '[events:1] filter_out', count(*) FROM events WHERE event_type = 'view'
    UNION ALL SELECT '[events:3] filter_in', count(*) FROM events WHERE event_type = 'view'
    UNION ALL SELECT '[events:3] filter_out', count(*) FROM events WHERE event_type = 'view' AND value > 50
    UNION ALL SELECT '[purchases:0] filter_in', count(*) FROM events
    UNION ALL SELECT '[purchases:0] filter_out', count(*) FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT '[events:5] stream_joiner_first_in', count(*) FROM events WHERE event_type = 'view' AND value > 50
    UNION ALL SELECT '[events:5] stream_joiner_second_in', count(*) FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT '[events:5] stream_joiner_out', n FROM ({COUNTED_SQL})"""


def counter_rows(spark: SparkSession, values: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(sorted(values.items()), "counter string, n bigint")


@register(COUNTED_SQL)
def job_counters_join(spark, folder):
    """A joiner, and a filter with an output before and behind it: every operator is counted once."""
    shared_dir(spark)
    inputs = {"events": event_records(table(spark, folder, "events"))}
    drop = lambda df, _: df.write.format("noop").mode("overwrite").save()
    built = run_batch(spark, COUNTED_JOB, inputs, targets=Targets({"out": drop, "views": drop, "late": drop}))
    return counter_rows(spark, built.counters.batch_values())


def streamed_counters(spark: SparkSession, folder: str, shared_reads: bool) -> DataFrame:
    totals: dict[str, int] = {}

    def add(_: str, values: dict[str, int]) -> None:
        for name, value in values.items():
            totals[name] = totals.get(name, 0) + value

    drop = lambda df, _: df.write.format("noop").mode("overwrite").save()
    inputs = {"events": event_records(stream(spark, folder, "events"))}
    queries = start_job(
        spark, COUNTED_JOB, work_path(spark, "counted").rsplit("/", 1)[1], inputs, lateness="1 day", available_now=True,
        targets=Targets({"out": drop, "views": drop, "late": drop}), shared_reads=shared_reads, publish=add,
    )
    for query in queries:
        add("", query_totals(query))
    return counter_rows(spark, totals)


@register(COUNTED_SQL)
def job_counters_stream(spark, folder):
    """The same counters from streaming queries that share their reads."""
    return streamed_counters(spark, folder, True)


@register(COUNTED_SQL)
def job_counters_stream_apart(spark, folder):
    """The same counters from a query per output."""
    return streamed_counters(spark, folder, False)


# --- rows that nothing but their content tells apart


@register(
    """WITH RECURSIVE f AS (SELECT DISTINCT l_returnflag, l_shipdate FROM lineitem),
       o AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS rn FROM f),
       a AS (SELECT * FROM o WHERE rn = 1
             UNION ALL
             SELECT n.* FROM a, LATERAL (SELECT o.* FROM o WHERE o.l_returnflag = a.l_returnflag
                                         AND o.l_shipdate > a.l_shipdate + INTERVAL 7 DAY ORDER BY rn LIMIT 1) n)
       SELECT l_returnflag, l_shipdate FROM a"""
)
def dedup_without_tiebreak(spark, folder):
    """Hot keys with many rows at the same instant and no tiebreak: one row for each kept instant."""
    items = table(spark, folder, "lineitem")
    return dedup(items, "l_returnflag", 7 * DAY, "l_shipdate", group_rows=share(items, 50)).select("l_returnflag", "l_shipdate")


@register(
    pair_shipments_sql("l_linestatus")
    + """
    SELECT k AS l_linestatus, count(*) AS pairs FROM pairs GROUP BY k"""
)
def pair_repeated_times(spark, folder):
    """Many rows at the same instant and no tiebreak, on the way for hot keys: the number of pairs of a key is fixed."""
    items = table(spark, folder, "lineitem")
    returned, kept = shipments(items, "l_linestatus")
    pairs = pair_join(returned, kept, "l_linestatus", "l_linestatus", 2 * DAY, "l_shipdate", group_rows=share(returned, 20))
    return pairs.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("pairs"))
