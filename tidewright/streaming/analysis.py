"""Analysis of scripts that arrive as a stream. Tokens and nodes are stateless, so `operators.analysis` takes a stream as it is; the rules look at one
script at a time, but need joins and windows over its nodes, so they run on each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import analysis
from ..sources.tables import scratch_table


def write_diagnostics(scripts: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes the diagnostics of each batch of scripts to out/batch=<number>. A batch that is run again after a failure
    replaces its own folder, so each script's diagnostics are there once. `trigger` goes to the stream's trigger; available_now ends it."""

    def batch(rows: DataFrame, number: int) -> None:
        nodes = scratch_table(analysis.nodes(rows), "stream-nodes")  # parsed once for all rules
        analysis.diagnostics(nodes).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return scripts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
