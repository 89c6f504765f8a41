"""Streams: append arriving texts to an LSH index, and filter arriving points by boxes. Both are stateless."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearbox.functions import vectors
from nearbox.operators import similarity
from nearbox.session import blocks


def append_bands(stream: DataFrame, key: str, column: str, path: str, checkpoint: str, use_shingles: bool = True, **trigger) -> StreamingQuery:
    """Write (key, band, band_key) rows of arriving texts to a Parquet index; a batch that is repeated replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        signed = similarity.with_signatures(similarity.with_tokens(batch, column, use_shingles))
        similarity.banded(signed, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def box_filter(stream: DataFrame, boxes: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Arriving points in the boxes (query_id, lo_<dim>, hi_<dim>) of a static table, taken in blocks of a broadcast's size."""
    on = vectors.in_box(dims, [F.col(f"lo_{d}") for d in dims], [F.col(f"hi_{d}") for d in dims])
    points = stream.filter(vectors.finite(dims))
    return reduce(DataFrame.unionByName, [points.join(F.broadcast(some), on) for some in blocks(boxes, "query_id")])
