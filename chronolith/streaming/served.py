"""The log of served frames behind a stream, once a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import evidence


def server(root: str, name: str, count: int = 1, out: str | None = None) -> Callable[[DataFrame, int], None]:
    """Serves a batch of probes (series, probe, at) of the stream ``name``.

    A batch that is run again has its name in the log and in ``out`` already and takes its own place there,
    so it counts once, whatever the stream did before it failed.
    """

    def serve(probes: DataFrame, batch: int) -> None:
        found = evidence.frames(probes.sparkSession, root, probes=probes, count=count, batch=f"{name}-{batch}")
        if out is not None:
            found.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return serve


def serve(probes: DataFrame, root: str, name: str, checkpoint: str, count: int = 1, out: str | None = None) -> StreamingQuery:
    """Serves a stream of probes from a store; the name must stay with the checkpoint."""
    return probes.writeStream.foreachBatch(server(root, name, count, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
