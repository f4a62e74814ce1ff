"""Scoring of streams by a fitted forest: stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.model import Forest


def score_stream(model: Forest, stream: DataFrame, row_id: str = "row_id"):
    """A foreachBatch function's worth of scoring: each micro-batch is predicted as a batch frame."""

    def each(sink):
        return lambda batch, epoch: sink(model.predict(batch, row_id), epoch)

    return lambda sink: stream.writeStream.foreachBatch(each(sink))


def score_nodes_stream(model: Forest, stream: DataFrame, row_id: str = "row_id") -> DataFrame:
    """A streaming frame (row_id, tree_id, node_id): the walk alone keeps no state."""
    return model.walked(model.encoded(stream, row_id), blocks=True)
