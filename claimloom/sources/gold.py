"""A small labelled set (fixed values): facts about two subjects, pairs with the label they must get, and pairs that must not be findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "fact_id string, doc_id string, page_no int, fact_kind string, entity string, metric string, value string, value_text string, unit string, magnitude string, period string, basis map<string,string>, quote string"


def _row(i, doc, page, metric, value=None, unit=None, scale=None, period=None, basis=None, entity="India", text=None, kind="measurement"):
    quote = f"{metric} of {entity}, {period}: {text or value} {unit or ''} {scale or ''}".strip() + f" ({i})"
    return (i, doc, page, kind, entity, metric, value, text, unit, scale, period, basis or {}, quote)


_REAL = lambda v, **x: {"price_basis": "constant prices", "measure": "GDP", "vintage": v} | x
ROWS = [
    _row("M1", "macro-2", 8, "real GDP growth", "6.5", "percent", None, "2024-25", _REAL("realized")),
    _row("M2", "macro-3", 10, "real GDP growth", "6.5", "percent", None, "FY2024/25", _REAL("realized")),
    _row("M3", "macro-1", 4, "real GDP growth", "6.4", "percent", None, "FY25", _REAL("first advance estimate")),
    _row("M4", "macro-2", 26, "real GVA growth", "6.4", "percent", None, "2024-25", _REAL("realized", measure="GVA", valuation="basic prices")),
    _row("M5", "macro-2", 17, "real GDP growth", "6.5", "percent", None, "2025-26", _REAL("projection")),
    _row("M6", "macro-3", 13, "real GDP growth", "6.6", "percent", None, "FY2025/26", _REAL("projection")),
    _row("D1", "company-2", 22, "revenue from operations", "74540.82", "INR", "million", "FY24", {"consolidation": "standalone"}, "Delhivery Limited"),
    _row("D2", "company-2", 22, "revenue from operations", "81415.38", "INR", "million", "FY24", {"consolidation": "consolidated"}, "Delhivery Limited"),
    _row("D3", "company-3", 6, "revenue from services", "8142", "INR", "crore", "FY24", {"consolidation": "consolidated"}, "Delhivery Limited"),
    _row("D4", "company-1", 88, "board role at Delhivery Limited", None, None, None, "as of 2022-05", {"status": "active"}, "Suvir Suren Sujan", "Non-Executive Nominee Director", "state"),
    _row("D5", "company-2", 33, "board role at Delhivery Limited", None, None, None, "effective 2023-08-24", {"status": "resigned"}, "Suvir Suren Sujan", "Non-Executive Director", "state"),
]
PAIRS = [
    ("M1", "M2", "CORROBORATES", None), ("M1", "M3", "CONTEXTUALLY_RECONCILED", "vintage"), ("M1", "M4", "CONTEXTUALLY_RECONCILED", "measure"), ("M5", "M6", "CONTRADICTS", None),
    ("D1", "D2", "CONTEXTUALLY_RECONCILED", "consolidation"), ("D2", "D3", "CORROBORATES", None), ("D4", "D5", "CONTEXTUALLY_RECONCILED", "period"),
]
NOT_FINDINGS = [("M3", "M4"), ("M2", "M6")]
ALIAS = [("revenue_from_operations", "revenue_from_services", True, "One company's statements use both names for this line.", "rule")]


KNOWN_FAILURES: list[tuple] = []


def pages(spark: SparkSession) -> DataFrame:
    """The pages that the labelled facts stand on."""
    by: dict[tuple, list[str]] = {}
    for r in ROWS:
        by.setdefault((r[1], r[2]), []).append(r[-1])
    return spark.createDataFrame([(d, n, "The page begins. " + " Then: ".join(q)) for (d, n), q in by.items()], "doc_id string, page_no int, page_text string")


def claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)
