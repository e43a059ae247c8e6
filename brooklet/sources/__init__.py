from brooklet.sources.lookup import lookup_table
from brooklet.sources.records import decode_json, file_records, kafka_options, kafka_records, topic_records

__all__ = ["decode_json", "file_records", "kafka_options", "kafka_records", "lookup_table", "topic_records"]
