"""Text normalisation for catalog metadata."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Texts that stand for no value, after light normalisation.
PLACEHOLDERS = ["UNKNOWN", "UNKNOWN AUTHOR", "UNTITLED", "N/A", "NONE", "-", "?"]
#: Words in a title that tell editions apart.
EDITION_MARKERS = ["REVISED", "EXPANDED", "ABRIDGED", "UNABRIDGED", "ILLUSTRATED", "ANNIVERSARY EDITION"]
EDITION_NUMBER = r"\b(?:\d+(?:ST|ND|RD|TH)|FIRST|SECOND|THIRD|FOURTH) EDITION\b"
_ASCII = r"^[\x00-\x7F]*$"


def _upper(text: str) -> str:
    """One character for one: what would expand (as the German sharp s) stays as it is."""
    return "".join(u if len(u := c.upper()) == 1 else c for c in text)


def _canonical(text: str | None) -> str | None:
    import regex

    if text is None or any("\ud800" <= c <= "\udfff" for c in text):
        return None
    text = unicodedata.normalize("NFC", _upper(unicodedata.normalize("NFC", text)))
    text = regex.sub(r"\s+", " ", regex.sub(r"\p{Cf}+", "", text)).strip()
    return unicodedata.normalize("NFC", regex.sub(r" (?=\p{P})|(?<=\p{P}) ", "", text)) or None


def _light(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFC", _upper(unicodedata.normalize("NFC", text.strip())))


@F.pandas_udf(StringType())
def _canonical_udf(text: pd.Series) -> pd.Series:
    return text.map(_canonical, na_action="ignore")


@F.pandas_udf(StringType())
def _light_udf(text: pd.Series) -> pd.Series:
    return text.map(_light, na_action="ignore")


def _by_script(text: Column, ascii_form: Column, udf) -> Column:
    plain = text.rlike(_ASCII)
    return F.when(plain, ascii_form).otherwise(udf(F.when(~plain, text)))  # Python sees nulls for plain rows


def canonical(text: Column) -> Column:
    """NFC and upper case, no format characters, one space for white space, none beside punctuation; nothing left: null."""
    spaced = F.trim(F.regexp_replace(F.upper(text), r"\s+", " "))
    return _by_script(text, F.nullif(F.regexp_replace(spaced, r" (?=\p{P})|(?<=\p{P}) ", ""), F.lit("")), _canonical_udf)


def light(text: Column) -> Column:
    """Trimmed, NFC, upper case."""
    return _by_script(text, F.upper(F.regexp_replace(text, r"^\s+|\s+$", "")), _light_udf)


def usable(text: Column) -> Column:
    """Neither empty nor a placeholder."""
    plain = light(text)
    return F.coalesce((plain != "") & ~plain.isin(PLACEHOLDERS), F.lit(False))


def signature(values: Column) -> Column:
    """Distinct values of an array of normalised texts, sorted, joined by a bar; none: null."""
    known = F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))
    return F.when(F.size(known) > 0, F.array_join(known, "|"))


def edition(title: Column) -> Column:
    """Edition markers and the first numbered edition in a title; none: null."""
    plain = light(title)
    found = F.array(*[F.when(plain.contains(m), F.lit(m)) for m in EDITION_MARKERS], F.nullif(F.regexp_extract(plain, EDITION_NUMBER, 0), F.lit("")))
    known = F.array_sort(F.array_compact(found))
    return F.when(F.size(known) > 0, F.array_join(known, "|"))


def safe_path(path: Column) -> Column:
    """Relative, no drive or stream mark, no parent step."""
    plain = F.translate(path, "\\", "/")
    return F.coalesce((path != "") & ~plain.startswith("/") & ~path.contains(":") & ~F.array_contains(F.split(plain, "/"), ".."), F.lit(False))
