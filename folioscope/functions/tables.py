"""Table functions for SQL: sections, claims, posts, report rows.

`SELECT ... FROM docs, LATERAL claim_rows(text)` after `register(spark)`.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession, functions as F

from .text import fold_case_sql


def register(spark: SparkSession) -> None:
    from ..operators.claims import blocks_sql
    from ..operators.radar import report_rows_sql
    from ..sources.notes import posts_sql

    class Sections:
        def eval(self, text: str):
            lines = (text or "").split("\n")
            marks = [i for i, l in enumerate(lines) if i == 0 or re.match(r"#{1,3} ", l)] + [len(lines)]
            for a, b in zip(marks, marks[1:]):
                for start in range(a, b, 250):
                    stop = min(start + 250, b)
                    body = "\n".join(lines[start:stop]).strip()
                    head = re.match(r"#{1,3} (.+)$", lines[start])
                    if body:
                        yield (head.group(1).strip() if head else "", start + 1, stop, body)

    spark.udtf.register("section_rows", F.udtf(Sections, returnType="heading string, start_line int, end_line int, content string"))
    for name, rows, schema in (
            ("claim_rows", blocks_sql, "seq int, claim string, evidence string, source_type string, source string, status string"),
            ("post_rows", posts_sql, "seq bigint, stamp string, host string, line string, via string, src string, dst string, field string, value string, text string"),
            ("report_rows", report_rows_sql, "index int, title string, id string, arxiv_id string, url string, relevance double, authors array<string>, abstract string")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(report STRING) RETURNS TABLE({schema}) RETURN SELECT r.* FROM (SELECT explode({rows('report')}) AS r)")


def register_functions(spark: SparkSession) -> None:
    """SQL helpers of the graph browser: full case folding as a SQL function of one text argument."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ulower(s STRING) RETURNS STRING RETURN {fold_case_sql('s')}")
