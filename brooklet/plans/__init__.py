from brooklet.plans.job import BuiltJob, Output, Records, build_job
from brooklet.plans.spec import check_job, dump_json, dump_yaml, load_json, load_yaml

__all__ = ["BuiltJob", "Output", "Records", "build_job", "check_job", "dump_json", "dump_yaml", "load_json", "load_yaml"]
