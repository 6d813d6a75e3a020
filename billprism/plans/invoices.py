"""Rules over the node relation of many invoices at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import xp
from .detect import clark


def line_sum_findings(nodes: DataFrame) -> DataFrame:
    """BR-CO-10 on UBL invoices: doc_id, rule_id, and both sums in whole cents, where the lines' net amounts are not the header's total.

    One aggregation on the document; partial sums are made where the nodes are.
    """
    below = F.regexp_replace("path_key", r"^/(\{[^}]*\})?[^/]*", "")
    amount = xp.cents(xp.decimal("sval", 30, 6))
    header = below == clark("/cac:LegalMonetaryTotal/cbc:LineExtensionAmount")
    line = below.isin(clark("/cac:InvoiceLine/cbc:LineExtensionAmount"), clark("/cac:CreditNoteLine/cbc:LineExtensionAmount"))
    rows = nodes.filter((F.col("kind") == "element") & (F.col("local") == "LineExtensionAmount"))
    per = rows.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(line, amount)), F.lit(0)).alias("line_sum"), F.max(F.when(header, amount)).alias("line_total"))
    return per.filter("line_total is not null and line_sum <> line_total").select("doc_id", F.lit("BR-CO-10").alias("rule_id"), "line_sum", "line_total")


def vat_breakdown_findings(lines: DataFrame, declared: DataFrame, tolerance: int = 100) -> DataFrame:
    """BR-x-08: breakdown rows whose taxable amount is not that of the lines of their category and rate: doc_id, category, rate, rule_id, taxable, of_lines.

    Amounts are cents; for standard rates a difference below ``tolerance`` passes, other categories are exact. Lines that no breakdown
    row stands for are BR-x-01's, a row without lines has 0 of them.
    """
    keys = ["doc_id", "category", "rate"]
    sums = lines.groupBy(*keys).agg(F.sum("net").alias("of_lines"))
    both = declared.select(*keys, "taxable").join(sums, keys, "left").withColumn("of_lines", F.coalesce("of_lines", F.lit(0)))
    off = F.abs(F.col("taxable") - F.col("of_lines"))
    return both.filter(F.when(F.col("category") == "S", off >= tolerance).otherwise(off > 0)).select(*keys, F.concat(F.lit("BR-"), "category", F.lit("-08")).alias("rule_id"), "taxable", "of_lines")
