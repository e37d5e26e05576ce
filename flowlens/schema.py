"""Declared schemas; nothing is inferred."""

PRICE_FILE = (
    "chart struct<result:array<struct<meta:struct<symbol:string>, timestamp:array<bigint>, indicators:struct<"
    "quote:array<struct<close:array<double>, volume:array<bigint>>>, adjclose:array<struct<adjclose:array<double>>>>>>>"
)
FILING_ARRAYS = "form array<string>, filingDate array<string>, items array<string>, acceptanceDateTime array<string>"
FILING_FILE = "filings struct<recent:struct<form:array<string>, filingDate:array<string>, items:array<string>, acceptanceDateTime:array<string>>>"
EVENT_TABLE = (
    "symbol string, report_date date, timing string, base int, base_date date, anchored int, dpi5 double, dpi10 double, next_day_ret double, w1_ret double, w2_ret double, m1_ret double, "
    "next_day_rvol double, w1_rvol double, w2_rvol double, m1_rvol double, looks_reaction int, has_data int, dpi5_pct double, dpi10_pct double"
)
#: A row of a spreadsheet in XML.
XML_ROW = "Cell array<struct<_Index:int, Data:struct<_VALUE:string>>>"
