"""Table sinks (S3-S6, S11): surrogate ids, catalog preflight, path / catalog / JDBC writers."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.operators.numbering import number_rows
from feedspark.session import materialize
from feedspark.sinks.commits import faults

_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _ident(name: str) -> str:
    """One quoting rule for every identifier (Q16): validated, then back-quoted."""
    parts = name.split(".")
    for p in parts:
        if not _IDENT.match(p):
            raise ValueError(f"bad identifier: {name!r}")
    return ".".join(f"`{p}`" for p in parts)


def with_ids(feed: DataFrame, order=("channel", "feed_date"), seq: str = "seq", start: int = 1) -> DataFrame:
    """A serial id in feed order (channel, date, number), starting at ``start``.

    Ties are settled by the other columns, so equal input gives equal ids; rows
    equal in every column are interchangeable.
    """
    ties = [c for c in feed.columns if c not in (*order, seq)]
    p = number_rows(feed, [], [*order, seq, *ties], out="_id")
    return p.withColumn("id", F.col("_id") + start).drop("_id")


def next_id(stored: DataFrame) -> int:
    """The id after the largest one in a table (1 for an empty table)."""
    return int(stored.agg(F.max("id")).first()[0] or 0) + 1


class Preflight(NamedTuple):
    """Whether a table can take the feed, and why not."""

    ok: bool
    reason: str = ""

    def __bool__(self) -> bool:
        return self.ok


REQUIRED = "feed.required"                 # table property: the columns that must not be null


def preflight(spark: SparkSession, table: str, column: str, location: str | None = None,
              extra_columns: dict[str, str] | None = None) -> Preflight:
    """Make sure ``table(id bigint, <column> string NOT NULL ...)`` exists with the columns and types.

    Creates the table when absent and adds missing columns when present.  A
    column of another type, or a refusal of the catalog, gives a false result
    with the reason instead of an exception.  File tables do not enforce NOT
    NULL themselves, so the columns are also kept as a table property and
    ``append_checked`` holds the rows against it.
    """
    cols = {"id": "BIGINT", column: "STRING"}
    cols.update(extra_columns or {})
    try:
        _ident(table)
        if not spark.catalog.tableExists(table):
            body = ", ".join(f"{_ident(c)} {t}{' NOT NULL' if c in ('id', column) else ''}" for c, t in cols.items())
            loc = f" LOCATION '{location}'" if location else ""
            spark.sql(f"CREATE TABLE IF NOT EXISTS {_ident(table)} ({body}) USING parquet{loc} "
                      f"TBLPROPERTIES ('{REQUIRED}' = 'id,{column}')")
            return Preflight(True)
        have = {f.name.lower(): f.dataType.simpleString() for f in spark.table(table).schema.fields}
        wanted = {c: spark.createDataFrame([], f"c {t}").schema["c"].dataType.simpleString() for c, t in cols.items()}
        if wrong := [f"{c} is {have[c.lower()]}, not {t}" for c, t in wanted.items() if have.get(c.lower(), t) != t]:
            return Preflight(False, "; ".join(wrong))
        if add := [(c, t) for c, t in cols.items() if c.lower() not in have]:
            spec = ", ".join(f"{_ident(c)} {t}" for c, t in add)
            spark.sql(f"ALTER TABLE {_ident(table)} ADD COLUMNS ({spec})")
        return Preflight(True)
    except (AnalysisException, ParseException, ValueError) as e:
        return Preflight(False, str(e).strip().splitlines()[0])


def required_columns(spark: SparkSession, table: str) -> list[str]:
    """The columns of a table that must not be null (see ``preflight``)."""
    props = spark.sql(f"SHOW TBLPROPERTIES {_ident(table)}").where(F.col("key") == REQUIRED).collect()
    return props[0]["value"].split(",") if props else []


def append_checked(df: DataFrame, table: str, quarantine: str) -> tuple[int, int]:
    """Append the rows that the table can take; the others go to ``quarantine`` with the reason.

    A row is refused for a null in a required column or for a value that does
    not convert to the column's type.  Returns (rows written, rows refused).
    Not safe against a retry; ``sinks/commits.py: append_once`` is.
    """
    spark = df.sparkSession
    kinds = {f.name.lower(): f.dataType for f in spark.table(table).schema.fields}
    required = {c.lower() for c in required_columns(spark, table)}
    judged = materialize(df.withColumn("reason", faults(df, kinds, required)), "judged", spark)
    good = judged.where("reason = ''").drop("reason")
    append_table(good.select(*[F.col(c).cast(kinds[c.lower()]).alias(c) if c.lower() in kinds else F.col(c) for c in good.columns]), table)
    refused = judged.where("reason <> ''")
    refused.write.mode("append").parquet(quarantine)
    return good.count(), refused.count()


def append_table(df: DataFrame, table: str) -> None:
    """S3 into a catalog table: columns matched by name; a column that the table lacks is an error, never dropped."""
    cols = [f.name for f in df.sparkSession.table(table).schema.fields]
    if lacking := sorted({c.lower() for c in df.columns} - {c.lower() for c in cols}):
        raise ValueError(f"table {table} lacks the columns {', '.join(lacking)}; run the preflight with them first")
    have = {c.lower() for c in df.columns}
    df.select(*[F.col(c) if c.lower() in have else F.lit(None).alias(c) for c in cols]).write.insertInto(table)


def append_path(df: DataFrame, path: str, partition_by=("feed_date",)) -> None:
    """S3 into a path table, partitioned by date for pruning."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None, batchsize: int = 10000,
                num_partitions: int | None = None) -> None:
    """S3 into a JDBC database: prepared batched inserts, one connection per partition.

    ``num_partitions`` caps concurrent connections (coalesce, no shuffle).
    """
    out = df.coalesce(num_partitions) if num_partitions else df
    props = dict(properties or {})
    props.setdefault("batchsize", str(batchsize))
    out.write.mode("append").jdbc(url, _ident(table).replace("`", ""), properties=props)


def write_quarantine(rejected: DataFrame, path: str) -> None:
    """Rejected rows with their reason, appended (by date of arrival)."""
    rejected.withColumn("arrival_date", F.to_date("arrival_ts")).write.mode("append").partitionBy(
        "arrival_date"
    ).parquet(path)
