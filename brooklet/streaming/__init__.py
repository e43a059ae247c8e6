from brooklet.streaming.dedup import dedup_stream
from brooklet.streaming.pairing import pair_rows_stream
from brooklet.streaming.run import Targets, await_job, run_batch, start_job

__all__ = ["Targets", "await_job", "dedup_stream", "pair_rows_stream", "run_batch", "start_job"]
