"""Table functions for SQL: links of pages, and a listing read until its rows are too old.

    register(spark)
    SELECT * FROM page_links(TABLE(pages), 'html')
    SELECT * FROM harvested(TABLE(listing) PARTITION BY category ORDER BY (page), 'newest', DATE '2024-01-01')

Both take tables of any columns and pass them through.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tendril.sources.html import parsed


class PageLinks:
    """The links of each page: all columns of the table but the page, then pos, href and text."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, html: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or html.value not in pages.dataType.names:
            raise ValueError("page_links takes a table and the name of its column of pages")
        kept = StructType([f for f in pages.dataType if f.name != html.value])
        return AnalyzeResult(kept.add("pos", IntegerType()).add("href", StringType()).add("text", StringType()))

    def eval(self, row: Row, html: str):
        kept = [row[c] for c in row.__fields__ if c != html]
        for link in parsed(row[html]).links:
            yield *kept, link["pos"], link["href"], link["text"]


class Harvested:
    """The rows of a partition, in its order, before the first one whose date is too old; rows without a date never are."""

    def __init__(self):
        self.stopped = False

    @staticmethod
    def analyze(rows: AnalyzeArgument, newest: AnalyzeArgument, oldest: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or newest.value not in rows.dataType.names:
            raise ValueError("harvested takes a table, the name of its column of dates and the oldest date wanted")
        return AnalyzeResult(rows.dataType)

    def eval(self, row: Row, newest: str, oldest: dt.date):
        self.stopped = self.stopped or (row[newest] is not None and row[newest] < oldest)
        if not self.stopped:
            yield tuple(row)


def register(spark: SparkSession) -> None:
    """Makes page_links and harvested known to the session's SQL."""
    spark.udtf.register("page_links", F.udtf(PageLinks))
    spark.udtf.register("harvested", F.udtf(Harvested))
