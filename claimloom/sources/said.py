"""The extractor as a table function: `SELECT * FROM extract_pages(TABLE(pages) PARTITION BY doc_id ORDER BY page_no)`.

The function is polymorphic: its rows have all columns of the given table and, behind these, `response` (JSON) and `attempts`. It is made of any Python function
of a page's text. Pages of a document come to it one after the other, so what it learns holds for the document: a text that was answered before is not
asked again, and after GIVE_UP failures in a row the rest of the document is left unanswered (null) instead of being tried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

GIVE_UP = 3


def register(spark: SparkSession, answer: Callable[[str], str], name: str = "extract_pages", text: str = "page_text") -> None:
    """answer: what is said about a text; it may raise for a text that it cannot read."""
    from pyspark.sql.functions import udtf

    class ExtractPages:
        def __init__(self):
            self.said, self.failures = {}, 0

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or text not in table.dataType.names:
                raise ValueError(f"a table with a column {text} is needed")
            out = StructType(list(table.dataType.fields))
            return AnalyzeResult(out.add("response", StringType()).add("attempts", IntegerType()))

        def eval(self, row):
            page, attempts = row[text], 0
            if page is not None and page not in self.said and self.failures < GIVE_UP:
                attempts = 1
                try:
                    self.said[page], self.failures = answer(page), 0
                except Exception:  # noqa: BLE001 - whatever the plugged function raises is a page without an answer
                    self.failures += 1
            yield (*row, self.said.get(page), attempts)

        def terminate(self):
            self.said, self.failures = {}, 0

    spark.udtf.register(name, udtf(ExtractPages))
