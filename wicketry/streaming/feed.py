"""The recent-match feed as a file stream: each batch appends only unseen matches, and bad documents to quarantine."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import DOCUMENT, PACKED, add, with_match_id
from ..sources.storage import read_text


def follow(spark: SparkSession, feed: str, path: str, checkpoint: str, packed: bool = False) -> StreamingQuery:
    """Start the stream over what is there now (availableNow), files of one document or ``packed`` ones; the checkpoint remembers files between runs.

    Each batch is committed with the stream's id and its number, so a batch that is repeated after a failure counts once.
    """
    if packed:
        docs = spark.readStream.schema(PACKED).parquet(feed)  # parsed by ``add``
    else:
        docs = with_match_id(spark.readStream.schema(DOCUMENT).option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(feed))

    def append(batch, number: int) -> None:
        stream = json.loads(read_text(batch.sparkSession, f"{checkpoint}/metadata"))["id"]
        add(batch, path, (stream, number))

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
