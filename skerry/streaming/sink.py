"""Structured Streaming into tables: every micro-batch is one append or keyed merge, once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_stream(stream: DataFrame, table, checkpoint: str, mode: str = "append", on: str | None = None, **trigger):
    """Start a query that feeds the table; mode append, upsert (keyed merge on `on`) or lsm.

    The number of each batch is a property of the version that its commit makes, so a batch that is
    replayed after a failure is recognised and left out.  A generation of the lsm tier that is replayed
    holds the same keys again, which changes nothing.
    """
    if mode not in ("append", "upsert", "lsm"):
        raise ValueError("mode is append, upsert or lsm")
    if mode == "upsert" and not on:
        raise ValueError("upsert needs a key")
    source = f"stream:{checkpoint}"

    def feed(batch: DataFrame, number: int) -> None:
        if table.checkout_latest().manifest().properties.get(source, -1) >= number:
            return
        rows = batch.select(*[c for c in table.columns if c in batch.columns])
        table.stamp = {source: number}
        try:
            if mode == "lsm":
                table.lsm().upsert(rows)
                table._commit(lambda m: m, "stream")
            elif mode == "upsert":
                table.merge_insert(on).when_matched_update_all().when_not_matched_insert_all().execute(rows)
            else:
                table.add(rows)
        finally:
            table.stamp = {}

    return stream.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
