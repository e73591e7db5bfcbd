"""Identities: stable hashes over canonical strings of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What tells one claim from another, besides where it was found.
IDENTITY = ["subject", "measure", "value_kind", "value", "unit", "currency", "text_value", "modality", "period_kind", "period_start", "period_end", "scope", "basis", "segment", "issuer"]
#: What two mentions in one document must share to be one claim; neither label nor precision.
DEDUP = ["doc_id", "subject", "measure", "period_kind", "period_start", "period_end", "scope", "basis", "segment", "issuer", "value_kind", "value", "unit", "currency", "text_value"]


def canonical(columns: list[str]) -> Column:
    """Values as text, joined by U+001F, with null told from the empty text."""
    return F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns])


def fact_id(columns: list[str] | None = None) -> Column:
    """`f_` and 12 digits over the claim's identity and the place of its evidence."""
    return F.concat(F.lit("f_"), F.substring(F.sha1(canonical(columns or [*IDENTITY, "doc_id", "page"])), 1, 12))


def cluster_key(subject: str = "subject", measure: str = "measure") -> Column:
    return F.concat_ws("::", subject, measure)


def block_key(subject: str = "subject", measure: str = "measure", value_kind: str = "value_kind") -> Column:
    """16 digits over exactly the three fields that two claims must share to be compared."""
    return F.substring(F.sha1(F.concat_ws("\u001f", subject, measure, value_kind)), 1, 16)


def relation_id(source: str = "source_id", target: str = "target_id", relation: str = "relation") -> Column:
    return F.substring(F.sha1(F.concat_ws("|", source, target, relation)), 1, 12)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def table_id(doc_id: Column, page: Column, x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    box = F.format_string("%.1f,%.1f,%.1f,%.1f", x0, top, x1, bottom)
    return F.format_string("%s_p%d_%s", doc_id, page, F.substring(F.sha1(box), 1, 8))


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def embedding_key(model: str, dimension: int, text: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.lit(model), F.lit(str(dimension)), text), 256)
