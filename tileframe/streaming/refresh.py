"""Refresh of a projection as a stream: each run appends the files that are new."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql.streaming import StreamingQuery

from ..plans.projections import STREAMED, Catalog


def stream_refresh(catalog: Catalog, name: str, checkpoint: str) -> StreamingQuery:
    """Starts an available-now run that appends to the projection its columns of the files
    that the source has gained since the last run with the same ``checkpoint``.

    The file sink's log makes each run's rows appear once and together; what reads the
    projection afterwards, substituted queries among it, sees them. A projection is
    refreshed either so or by ``Catalog.refresh``. It takes every row of a new file, those
    with an order key below the greatest one and without any too.
    """
    own = catalog.projections[name.lower()]
    if own.version not in (None, STREAMED):
        raise ValueError(f"projection {own.name} is refreshed by batches")
    if own.version is None:
        own = catalog._store(replace(own, version=STREAMED))
    rows = catalog.spark.readStream.schema(catalog.source(own.source).schema).parquet(catalog.sources[own.source]).select(*own.columns)
    sink = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", catalog.data_path(name))
    catalog.generation += 1
    return sink.trigger(availableNow=True).start()
