"""Reading a delivered feed on from a position (S7, S9): a streaming source whose offset is the row id.

Every delivered batch leaves a record of the ids it holds (``sinks.deliver``).
The source's latest offset is the last recorded id, so a batch is seen once it
is complete; what lies behind a consumer's own offset, kept in its checkpoint,
is read in the order of ids, a partition per file that holds some of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from feedspark import schemas

NAME = "delivered_feed"
ROWS = T.StructType([T.StructField("id", T.LongType()), *schemas.FEED.fields])


def ids_path(path: str) -> str:
    """Where the records of a delivered table lie: (batch_id, first, last), one small file per batch."""
    return path.rstrip("/") + "_ids"


def _dataset(path: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return ds.dataset(root, filesystem=files, format="parquet", partitioning="hive")


class _Run(InputPartition):
    def __init__(self, batch: int, low: int, high: int):
        self.batch, self.low, self.high = batch, low, high


class DeliveredReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.first = options["path"], int(options.get("position", 0))

    def _records(self) -> list[tuple[int, int, int]]:
        t = _dataset(ids_path(self.path)).to_table(columns=["n", "first", "last"])
        return sorted(zip(*(t.column(c).to_pylist() for c in ("n", "first", "last"))))

    def initialOffset(self) -> dict:
        return {"id": self.first}

    def latestOffset(self) -> dict:
        return {"id": max([self.first, *(last for _, _, last in self._records())])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["id"], end["id"]
        return [_Run(n, max(low, first - 1), min(high, last)) for n, first, last in self._records() if first <= high and last > low and first <= last]

    def read(self, partition: _Run) -> Iterator:
        import pyarrow.compute as pc

        own = _dataset(f"{self.path.rstrip('/')}/batch_id={partition.batch}")
        wanted = (pc.field("id") > partition.low) & (pc.field("id") <= partition.high)
        # files of a batch hold contiguous runs of ids; one is read at a time, in their order
        runs = []
        for file in own.get_fragments():
            stats = [(g.statistics or {}).get("id") for g in file.row_groups]
            if not all(stats):             # written without statistics: look at the ids
                stats = [{"min": i} for i in file.to_table(columns=["id"]).column("id").to_pylist()]
            if stats:
                runs.append((min(x["min"] for x in stats), file))
        for _, file in sorted(runs, key=lambda r: r[0]):
            table = file.to_table(columns=ROWS.fieldNames(), filter=wanted).sort_by("id")
            yield from table.to_batches(max_chunksize=10_000)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class DeliveredSource(DataSource):
    """``spark.readStream.format("delivered_feed").option("path", ...)``; ``position``: the last id not wanted any more."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return ROWS

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return DeliveredReader(self.options)


def read_on(spark: SparkSession, path: str, position: int = 0) -> DataFrame:
    """The delivered rows behind ``position`` as a stream; a consumer's checkpoint keeps how far it came."""
    spark.dataSource.register(DeliveredSource)
    return spark.readStream.format(NAME).option("path", path).option("position", position).load()
