"""Composites kept fresh from a stream of changes.

Every micro-batch of the change log (c, s, p) finds the composites it touches and makes them anew. The store is a keyed table, of
which a batch writes the buckets it touches as a version of its own; a batch that is run again makes the same version, so results
are exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.session import written
from tessera.sources.keyed import KeyedTable


def maintain(changes: DataFrame, store: KeyedTable, keys_of: Callable[[DataFrame, DataFrame], DataFrame], make: Callable[[DataFrame], DataFrame], checkpoint: str, keep: int = 10, **trigger: object) -> StreamingQuery:
    """A running query that refreshes the store for each batch of changes.

    keys_of(rows, batch) names the composites to refresh (root_r, root_c), make(keys) makes them. Version 0 of the store is
    there before; batch n makes version n + 1 from the newest version before it; the newest `keep` versions stay. `checkpoint` is
    a folder that all executors share. trigger: as for writeStream, what there is at the moment without one.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = store.read(below=number + 1)
        keys = written(keys_of(rows, batch.distinct()), "keys")
        store.replace(make(keys), keys.select(F.col("root_r").alias("r"), F.col("root_c").alias("c")), version=number + 1)
        store.expire(keep)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
