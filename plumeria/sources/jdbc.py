"""JDBC tables: partitioned scans, query scans, and appends."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class JdbcTables:
    """A database reached through JDBC; secrets come in as properties, not from files."""

    url: str
    properties: dict[str, str] = field(default_factory=dict)
    fetch_rows: int = 10_000

    def scan_options(
        self, table: str, column: str | None = None, low=None, high=None, partitions: int = 1
    ) -> dict[str, str]:
        """Reader options; with a column and its bounds the scan is cut into ranges."""
        options = {"url": self.url, "dbtable": table, "fetchsize": str(self.fetch_rows), **self.properties}
        if column is not None:
            options |= {
                "partitionColumn": column,
                "lowerBound": str(low),
                "upperBound": str(high),
                "numPartitions": str(partitions),
            }
        return options

    def query_options(self, query: str) -> dict[str, str]:
        return {"url": self.url, "query": query, "fetchsize": str(self.fetch_rows), **self.properties}

    def append_options(self, table: str, batch_rows: int = 10_000, writers: int = 8) -> dict[str, str]:
        return {
            "url": self.url,
            "dbtable": table,
            "batchsize": str(batch_rows),
            "numPartitions": str(writers),
            **self.properties,
        }

    def scan(self, spark: SparkSession, table: str, column: str | None = None, partitions: int = 32) -> DataFrame:
        """A whole table. With a split column its bounds are read first, by the database."""
        if column is None:
            return spark.read.format("jdbc").options(**self.scan_options(table)).load()
        bounds = self.query(spark, f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}").first()
        if bounds["low"] is None:
            return spark.read.format("jdbc").options(**self.scan_options(table)).load()
        options = self.scan_options(table, column, bounds["low"], bounds["high"], partitions)
        return spark.read.format("jdbc").options(**options).load()

    def query(self, spark: SparkSession, query: str) -> DataFrame:
        """The result of a query the database runs."""
        return spark.read.format("jdbc").options(**self.query_options(query)).load()

    def append(self, df: DataFrame, table: str) -> None:
        df.write.format("jdbc").mode("append").options(**self.append_options(table)).save()
