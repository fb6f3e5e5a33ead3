"""Book identifiers: canonical types and validated, normalised values (null when invalid)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical_type(kind: Column) -> Column:
    plain = F.upper(F.trim(kind))
    return (
        F.when(plain.isin("ISBN", "ISBN10", "ISBN13"), "ISBN")
        .when(plain == "DOI", "DOI")
        .when(plain.isin("ASIN", "AMAZON"), "ASIN")
        .when(plain.isin("OCLC", "WORLD-CAT", "WORLDCAT"), "OCLC")
    )


def isbn(value: Column, strict: bool = True) -> Column:
    """ISBN-10 or ISBN-13 with a right check digit; `strict` allows X in the last place alone."""
    plain = F.upper(F.regexp_replace(value, "[^0-9Xx]", ""))
    digit = lambda i: F.when(F.substring(plain, i + 1, 1) == "X", F.lit(10)).otherwise(F.expr("try_cast('0' AS int)") + F.ascii(F.substring(plain, i + 1, 1)) - 48)
    ten = sum((digit(i) * (10 - i) for i in range(1, 10)), digit(0) * 10) % 11 == 0
    thirteen = (10 - sum((digit(i) * (1 if i % 2 == 0 else 3) for i in range(1, 12)), digit(0)) % 10) % 10 == digit(12)
    shape = r"^[0-9]{9}[0-9X]$" if strict else r"^[0-9X]{10}$"
    return F.when(plain.rlike(shape) & ten, plain).when(plain.rlike(r"^[0-9]{13}$") & thirteen, plain)


def doi(value: Column) -> Column:
    plain = F.upper(F.trim(F.regexp_replace(F.trim(value), r"(?i)^(https://doi\.org/|http://doi\.org/|doi:)", "")))
    return F.when(plain.startswith("10.") & plain.contains("/") & ~plain.rlike(r"\s"), plain)


def asin(value: Column) -> Column:
    plain = F.upper(F.trim(value))
    return F.when(plain.rlike(r"^[\p{L}\p{Nd}]{10}$"), plain)


def oclc(value: Column) -> Column:
    plain = F.regexp_replace(F.upper(F.trim(value)), r"^(OCLC|OCM|OCN|ON)[: ]*", "")
    return F.when(plain.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.regexp_replace(plain, "^0+", ""), F.lit("")), F.lit("0")))


def strong(kind: Column, value: Column) -> Column:
    """`TYPE:value` of a valid strong identifier."""
    name = canonical_type(kind)
    found = F.when(name == "ISBN", isbn(value)).when(name == "DOI", doi(value)).when(name == "ASIN", asin(value)).when(name == "OCLC", oclc(value))
    return F.when(found.isNotNull(), F.concat(name, F.lit(":"), found))
