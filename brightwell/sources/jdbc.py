"""Parallel scans of database tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Connection addresses and identifier quotes per kind of database.
URLS = {
    "mysql": "jdbc:mysql://{host}:{port}/{database}?serverTimezone=UTC",
    "doris": "jdbc:mysql://{host}:{port}/{database}?serverTimezone=UTC",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
}
#: Added to the address of an encrypted and of an open connection.
SECURE = {"mysql": "&sslMode=REQUIRED", "doris": "&sslMode=REQUIRED", "sqlserver": ";encrypt=true"}
OPEN = {"mysql": "&sslMode=DISABLED&allowPublicKeyRetrieval=true", "doris": "&sslMode=DISABLED&allowPublicKeyRetrieval=true",
        "sqlserver": ";encrypt=false"}
QUOTES = {"mysql": "``", "doris": "``", "postgresql": '""', "oracle": '""', "sqlserver": "[]", "derby": '""'}
FETCH_SIZE = 10_000


@dataclass(frozen=True)
class Connection:
    """Where a database is. ``url`` overrides the address built from the parts; ``encrypted`` may be turned off."""

    kind: str
    host: str = ""
    port: int = 0
    database: str = ""
    schema: str | None = None
    user: str | None = None
    password: str | None = None
    url: str | None = None
    encrypted: bool = True
    options: dict[str, str] = field(default_factory=dict)

    def address(self) -> str:
        if self.url:
            return self.url
        if self.kind not in URLS:
            raise ValueError(f"unsupported database kind {self.kind}")
        address = URLS[self.kind].format(host=self.host, port=self.port, database=self.database)
        address += (SECURE if self.encrypted else OPEN).get(self.kind, "")
        return f"{address}?currentSchema={self.schema}" if self.kind == "postgresql" and self.schema else address

    def qualified(self, table: str) -> str:
        """The quoted table name, with schema or database where the kind has one in front."""
        opening, closing = QUOTES.get(self.kind, '""')
        front = {"mysql": self.database, "doris": self.database, "sqlserver": self.schema or "dbo"}.get(
            self.kind, self.schema)
        return ".".join(f"{opening}{p.replace(closing, closing * 2)}{closing}" for p in (front, table) if p)


def read_jdbc(spark: SparkSession, connection: Connection, table: str, columns: Sequence[str] | None = None,
              predicate: Column | None = None, split_by: str | None = None, partitions: int = 16) -> DataFrame:
    """A table scan. Filter and columns travel to the database.

    With ``split_by`` (numeric, date or timestamp) the range of the column is cut into ``partitions`` ranges read in
    parallel; the bounds come from one aggregate answered by the database.
    """
    def reader():
        options = {"url": connection.address(), "fetchsize": str(FETCH_SIZE), **connection.options}
        if connection.user:
            options |= {"user": connection.user, "password": connection.password or ""}
        return spark.read.format("jdbc").options(**options)

    name = connection.qualified(table)
    scan = reader().option("dbtable", name)
    if split_by:
        bounds = reader().option("dbtable", name).load().agg(
            F.min(split_by).cast("string").alias("lo"), F.max(split_by).cast("string").alias("hi")).first()
        if bounds["lo"] is not None and bounds["lo"] != bounds["hi"]:
            scan = scan.options(partitionColumn=split_by, lowerBound=bounds["lo"], upperBound=bounds["hi"],
                                numPartitions=str(partitions))
    df = scan.load()
    if predicate is not None:
        df = df.filter(predicate)
    return df.select(*columns) if columns else df
