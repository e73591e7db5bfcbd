"""Names, addresses and other text as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dropped from the end and from the start of a name, longest first.
COMPANY_SUFFIXES = [
    "private limited", "pvt limited", "pvt. ltd.", "pvt ltd", "pvt.", "private", "limited", "ltd.", "ltd", "llp", "inc.", "inc",
    "corporation", "corp.", "corp", "company", "co.", "plc", "gmbh",
]
HONORIFICS = ["mr.", "mr", "mrs.", "mrs", "ms.", "ms", "dr.", "dr", "shri", "smt.", "smt", "sri", "prof.", "prof", "cs", "ca"]

# Address spellings, replaced in this order.
ADDRESS_WORDS = {
    r"\bno\.?\b": "", r"\bd\.?no\.?\b": "", r"\bdoor\s+no\.?\b": "", r"\bst\b": "street", r"\brd\b": "road",
    r"\bave\b": "avenue", r"\bcr\b": "cross", r"\bmn\b": "main", r"\bapt\b": "apartment", r"\bblk\b": "block",
    r"\bfl\b": "floor", r"\bopp\.?\b": "opposite", r"\bnr\.?\b": "near", r"\bbangalore\b": "bengaluru",
    r"\bbombay\b": "mumbai", r"\bmadras\b": "chennai", r"\bcalcutta\b": "kolkata", r"\bpoona\b": "pune",
    r"\btrivandrum\b": "thiruvananthapuram", r"\bgurgaon\b": "gurugram",
}
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}

# Label words of the retrieval text, ignored in queries.
LABEL_WORDS = [
    "subject", "measure", "value", "kind", "unit", "currency", "period", "scope", "modality", "issuer", "segment", "geography", "basis",
]


def one_spaced(text: Column) -> Column:
    """Blanks collapsed to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_entity(name: Column) -> Column:
    """A key under which the spellings of a person's or company's name meet."""
    t = one_spaced(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s.&-]", " "))
    for word in sorted(HONORIFICS, key=len, reverse=True):
        t = F.regexp_replace(t, rf"^{re.escape(word)}\s+", "")
    for word in sorted(COMPANY_SUFFIXES, key=len, reverse=True):
        t = F.regexp_replace(t, rf"\s+{re.escape(word)}$", "")
    return F.coalesce(one_spaced(F.regexp_replace(t, "[.&,-]", " ")), F.lit(""))


def normalize_address(address: Column) -> Column:
    """Sorted distinct words of an address, with pin codes joined and spellings unified."""
    t = F.regexp_replace(F.lower(address), r"(\d{3})\s+(\d{3})\b", "$1$2")
    t = one_spaced(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " "))
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    t = F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(roman, w), w)), " ")
    for pattern, word in ADDRESS_WORDS.items():
        t = F.regexp_replace(t, pattern, word)
    t = F.regexp_replace(t, r"(\d+)(st|nd|rd|th)\b", "$1")
    t = F.regexp_replace(t, r"\b(indira)\s+(nagar)\b", "$1$2")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != ""))), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Common words over all words; 0 if either side has none."""
    x, y = (F.filter(F.split(s, " "), lambda w: w != "") for s in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def address_similarity(a: Column, b: Column) -> Column:
    return jaccard(normalize_address(a), normalize_address(b))


def detect_scope(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.contains("consolidated"), "consolidated")
        .when(t.contains("standalone") | t.contains("separate financial"), "standalone")
        .when(t.contains("segment"), "segment")
        .otherwise("unknown")
    )


def detect_basis(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for word in ("reviewed", "restated", "provisional", "audited", "unaudited"):
        out = F.when(t.contains(word), F.lit(word)).otherwise(out)
    return out


def lookup_key(text: Column) -> Column:
    """Lower case, marks to spaces, blanks collapsed."""
    return one_spaced(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))


def slug(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "unknown").otherwise(t)


def tokens(text: Column) -> Column:
    """Words of a search: runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), 1)


def query_tokens(text: Column) -> Column:
    """Words of a query without the label words, each once."""
    return F.array_distinct(F.filter(tokens(text), lambda w: ~w.isin(LABEL_WORDS)))


def edge_line(line: Column) -> Column:
    """A page's edge line with digits masked, so that page numbers don't tell lines apart."""
    return F.regexp_replace(F.lower(one_spaced(line)), r"\d+", "#")


def is_number_cell(text: Column) -> Column:
    """Whether a whole table cell is a number, perhaps in brackets or with a currency or percent sign."""
    return F.coalesce(F.trim(text), F.lit("")).rlike(r"^[(]?\s*[-+−]?\s*[₹$€£]?\s*\d[\d,]*(\.\d+)?\s*%?\s*[)]?$")


def with_percent_word(text: Column, unit: Column) -> Column:
    """Appends the word to a unit text that has only the sign."""
    return F.when(unit.contains("%") & ~F.lower(text).contains("percent"), F.concat(text, F.lit(" percent"))).otherwise(text)


def safe_filename(name: Column) -> Column:
    """Last path segment of safe characters, ending in .pdf."""
    base = F.regexp_replace(F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1), r"\.\.", "")
    base = F.regexp_replace(base, "[^A-Za-z0-9._ -]", "_")
    base = F.when(F.coalesce(F.trim(base), F.lit("")) == "", "upload").otherwise(base)
    return F.when(F.lower(base).endswith(".pdf"), base).otherwise(F.concat(base, F.lit(".pdf")))


def short_error(message: Column, root: str = "/") -> Column:
    """At most 300 characters, without local paths."""
    return F.substring(F.regexp_replace(message, re.escape(root.rstrip("/")) + r"/\S*", "<path>"), 1, 300)


def retrieval_text(prefix: str = "") -> Column:
    """The fixed ten lines that stand for a claim in a search."""
    c = lambda name: F.coalesce(F.col(f"{prefix}{name}").cast("string"), F.lit(""))
    lines = [("subject", "subject"), ("measure", "measure"), ("value kind", "value_kind"), ("unit", "unit"), ("currency", "currency"), ("period", "period_label"), ("scope", "scope"), ("modality", "modality"), ("issuer", "issuer"), ("segment", "segment")]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), c(name)) for label, name in lines])
