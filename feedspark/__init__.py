"""Feed ingestion and completeness on Spark.

Decode and authenticate numbered packets under rotating keys, parse them into
dated, sequence-numbered messages, find every lost number, backfill from an
archive, merge, and deliver as table rows or fixed-size frames -- as batch
DataFrames and as Structured Streaming queries.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Serialize this package's UDF code by value so executors need no install.

    Python workers then receive the function bodies with the task instead of
    importing ``feedspark`` themselves (works the same on a cluster).
    """
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
