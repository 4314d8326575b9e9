"""All registered queries with their oracle statements."""

import tempfile

from . import layers, market_queries, ml_queries, operator_queries, stats_queries

MODULES = [layers, market_queries, operator_queries, stats_queries, ml_queries]


def _with_scratch(query):
    """The query after a checkpoint folder has been named, where a local session has none."""
    def run(spark, sf_dir):
        context = spark.sparkContext
        if context.master.startswith("local[") and not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checks-"))
        return query(spark, sf_dir)
    return run


def queries():
    out = {}
    for m in MODULES:
        for name, entry in m.ENTRIES.items():
            assert name not in out, name
            out[name] = _with_scratch(entry[0])
    return out


def oracle_sql():
    return {name: entry[1] for m in MODULES for name, entry in m.ENTRIES.items() if entry[1]}
