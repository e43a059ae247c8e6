from brooklet.operators.asof import enrich_as_of
from brooklet.operators.deduplication import dedup
from brooklet.operators.enrichment import enrich
from brooklet.operators.fields import change_field, create_field, delete_field, filter_rows
from brooklet.operators.pairing import pair_join

__all__ = ["change_field", "create_field", "dedup", "delete_field", "enrich", "enrich_as_of", "filter_rows", "pair_join"]
