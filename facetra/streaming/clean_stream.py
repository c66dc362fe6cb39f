"""Row-wise cleaning of a stream.

The row-wise cleaning steps are projections and filters, so a streaming
DataFrame passes through them unchanged in meaning. De-duplication keeps the
best row of all, which a stream cannot know; it stays a batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import clean_rows, validate_cleaning_columns
from ..spec import TRACKS, FeatureSpec


def clean_stream(
    stream: DataFrame, path: str, checkpoint: str, spec: FeatureSpec = TRACKS
) -> StreamingQuery:
    """Append cleaned rows of what has arrived to Parquet files, then stop."""
    validate_cleaning_columns(stream, spec)
    return (
        clean_rows(stream, spec)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
