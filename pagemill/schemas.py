"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

ANSWER = "struct<query:string,value:string,bounding_box:array<double>,index:int>"
VQA = f"images array<binary>, queries array<string>, answers array<{ANSWER}>, source string, variant string, page_start int, page_end int, split string"
KVP = "image binary, kvps array<struct<key:string,value:string,bounding_box:array<string>>>, hash_name string, page_number string, split string"
TEMPLATE = "template string, schema array<string>, class string, source string"
FIELD = "name string, value string, page int, bbox array<double>"
DOCUMENT = "path string, title string, summary string, pages array<struct<index:int,summary:string>>"
FACT = "fact_id string, name string, concept string, period string, members array<string>, value string, raw_text string, page int, bbox array<double>, row_text string"
PREDICTION = "array<struct<query:string,value:string,box_2d:array<int>,index:int>>"
FILING = "cik string, ticker string, form string, accession string, document string, filing_date string"
