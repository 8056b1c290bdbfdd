"""A catalog and its index written once and read by many queries.

Entries are stored by kind, so a type test prunes partitions; postings and trigrams are
range-partitioned and sorted by key, so a lookup skips row groups by their statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from siftwood.operators.index import Index, build
from siftwood.sources import catalog


@dataclass
class Workspace:
    spark: SparkSession
    folder: str

    @staticmethod
    def create(spark: SparkSession, entries: DataFrame, documents: DataFrame, folder: str) -> Workspace:
        entries.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/entries")
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # few input files would leave the analysis to few tasks
        documents.select("doc_id", "text").repartition(parts, "doc_id").write.mode("overwrite").parquet(f"{folder}/documents")
        space = Workspace(spark, folder)
        build(space.documents).write(f"{folder}/index", parts)
        return space

    @property
    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/entries").select(*catalog.COLUMNS)

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/documents")

    @property
    def index(self) -> Index:
        return Index.read(self.spark, f"{self.folder}/index")
