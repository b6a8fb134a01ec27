"""Queries on web pages and scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdoc.llm.mainbody import main_body
from loomdoc.llm.scans import repair_evidence, repaired_pages
from loomdoc.session import table

SQL: dict[str, str] = {}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "web_pages").select("page_id", "url", "html")
    return main_body(pages, "page_id", "html", "url").select("page_id", "block_md5").distinct()


QUERIES = {"p2_found": p2_found}


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return repair_evidence(table(spark, sf, "pdf_pages").select("pdf_id", "page", "text", "ocr_used"))


QUERIES["p7_found"] = p7_found


def p7_text(spark: SparkSession, sf: str) -> DataFrame:
    return repaired_pages(table(spark, sf, "pdf_pages").select("pdf_id", "page", "text", "ocr_used"))


QUERIES["p7_text"] = p7_text
