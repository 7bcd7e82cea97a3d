"""Documents as a stream into the index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import entries
from ..operators.kb import Kb
from ..operators.resolve import Step


def put(docs: DataFrame, kb: Kb, path: str, checkpoint: str, errors: tuple[int, ...] = (), resolvers: Sequence[Step] = ()) -> StreamingQuery:
    """Match every new document of a stream (path, text), resolve what is ambiguous and append its postings to the Parquet index, one commit for each
    micro-batch; all that is there is read, then the query ends. A batch that is run again after a failure replaces what it had written: its folder is named by
    its number."""

    def write(batch: DataFrame, number: int) -> None:
        entries(batch, kb, errors, resolvers).sortWithinPartitions("concept_url", "path", "begin").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
