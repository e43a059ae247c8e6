from brooklet.sinks.buckets import bucket_stream, bucketed, read_buckets, write_buckets
from brooklet.sinks.contract import check_title, check_warehouse_fields
from brooklet.sinks.ledger import JdbcStore, append_once, ledger_setup
from brooklet.sinks.topics import json_value, read_back_topic, topic_writer
from brooklet.sinks.warehouse import Warehouse, append_rows, count_rows, run_init, table_columns

__all__ = [
    "JdbcStore", "Warehouse", "append_once", "append_rows", "bucket_stream", "bucketed", "check_title", "check_warehouse_fields", "count_rows",
    "json_value", "ledger_setup", "read_back_topic", "read_buckets", "run_init", "table_columns", "topic_writer", "write_buckets",
]
