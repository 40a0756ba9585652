"""Electronic invoices among a document's attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import INVOICE_NAMES, is_invoice_content, is_invoice_name


def has_invoice(attachments: DataFrame, key: str, name: str = "filename") -> DataFrame:
    """(key, is_invoice): whether any attachment is named as one, in any case."""
    return attachments.groupBy(key).agg(F.bool_or(is_invoice_name(F.col(name))).alias("is_invoice"))


def invoice_of(attachments: DataFrame, key: str, order: str = "ord", name: str = "filename", content: str = "content") -> DataFrame:
    """(key, filename, content): the attachment with the first of the known names, case and all, that has content;
    else the first .xml attachment whose content looks like an invoice; else nulls."""
    known = F.array_position(F.array(*[F.lit(x) for x in INVOICE_NAMES]), F.col(name))
    named = F.col(content).isNotNull() & (known > 0)
    other = F.lower(name).endswith(".xml") & is_invoice_content(F.col(content))
    rank = F.when(named, F.struct(F.lit(0).alias("way"), known.cast("long").alias("at"), F.col(order).cast("long").alias("ord")))
    rank = rank.when(other, F.struct(F.lit(1).alias("way"), F.lit(0).cast("long").alias("at"), F.col(order).cast("long").alias("ord")))
    best = F.min_by(F.struct(F.col(name).alias("filename"), F.col(content).alias("content")), rank)
    return attachments.groupBy(key).agg(best.alias("b")).select(key, "b.filename", "b.content")
