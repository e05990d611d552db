"""Identifiers and names: normal forms of DOIs, PMIDs, titles and surnames, and record ids."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Resolver and label prefixes of a DOI, its valid form, the label of a PMID, initials.
DOI_PREFIXES = r"(?i)^(?:\s*(?:(?:https?://)?(?:www\.|dx\.)?doi\.org/|doi\s*:\s*|doi\s+))+"
DOI_FORM = r"^10\.[0-9]+(?:\.[0-9]+)*/\S+$"
DOI_TRAILING = r"[.,;:'\"\s]+$"
PMID_PREFIX = r"(?i)^pmid\s*[:#]?\s*"
INITIALS = r"^[A-Z]{1,4}$"


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def percent_decoded(c: Column) -> Column:
    """Percent escapes decoded; plus signs and malformed escapes stay as they are."""
    safe = F.regexp_replace(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), c)


def doi(c: Column) -> Column:
    """Lower-case DOI without resolver, label or closing punctuation; null unless 10.<digits>/<suffix>."""
    bare = F.regexp_replace(stripped(percent_decoded(c)), DOI_PREFIXES, "")
    text = F.lower(F.regexp_replace(stripped(bare), DOI_TRAILING, ""))
    return F.when(text.rlike(DOI_FORM), text)


def pmid(c: Column) -> Column:
    """Canonical digits of a positive id of at most nine digits; else null."""
    text = stripped(F.regexp_replace(stripped(c.cast("string")), PMID_PREFIX, ""))
    number = F.when(text.rlike(r"^[0-9]{1,9}$"), text.cast("bigint"))
    return F.when(number > 0, number.cast("string"))


_TAG, _GAP = re.compile(r"<[^>]+>"), re.compile(r"[\W_]+")


def fold_text(text: str) -> str:
    """HTML unescaped, tags as spaces, compatibility-decomposed without marks, case-folded."""
    flat = unicodedata.normalize("NFKD", _TAG.sub(" ", html.unescape(text)))
    return "".join(ch for ch in flat if not unicodedata.combining(ch)).casefold()


def _vectorised(fn):
    @F.pandas_udf(StringType())  # a type object: workers import this without a session
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x) or None)

    return run


def title_of(text: str | None) -> str | None:
    return None if text is None else _GAP.sub(" ", fold_text(text)).strip() or None


def surname_of(name: str | None) -> str | None:
    """Before a comma; else without closing initials; else the last word - folded, letters and digits only."""
    words = name.split() if name else []
    if not words:
        return None
    if "," in name:
        part = name.split(",", 1)[0]
    elif len(words) > 1 and re.match(INITIALS, words[-1]):
        part = " ".join(words[:-1])
    else:
        part = words[-1]
    return _GAP.sub("", fold_text(part)) or None


#: Normal form of any title or journal, and of any author's surname (Arrow batches: Spark has no NFKD).
title_form = _vectorised(title_of)
surname_form = _vectorised(surname_of)


def ascii_title(c: Column) -> Column:
    """title_form for ASCII texts without markup, inside the JVM."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(""))


def ascii_surname(c: Column) -> Column:
    """surname_form for ASCII names."""
    name = stripped(c)
    words = F.split(name, r"\s+")
    part = (
        F.when(F.instr(name, ",") > 0, F.substring_index(name, ",", 1))
        .when((F.size(words) > 1) & F.element_at(words, -1).rlike(INITIALS), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " "))
        .otherwise(F.element_at(words, -1))
    )
    return F.when(name != "", F.nullif(F.regexp_replace(F.lower(part), "[^a-z0-9]+", ""), F.lit("")))


def record_id(database: Column, doi_: Column, pmid_: Column, title: Column, year: Column, surname: Column, url: Column) -> Column:
    """rec_ and 16 hex digits of the SHA-256 of the best identifying key. title and surname: normal forms."""
    blank = F.lit("")
    key = (
        F.when(doi_.isNotNull(), F.concat(database, F.lit("|doi:"), doi_))
        .when(pmid_.isNotNull(), F.concat(database, F.lit("|pmid:"), pmid_))
        .otherwise(F.concat(database, F.lit("|title:"), F.coalesce(title, blank), F.lit("|year:"), F.coalesce(year.cast("string"), F.lit("None")),
                            F.lit("|fa:"), F.coalesce(surname, blank), F.lit("|url:"), F.coalesce(url, blank)))
    )
    return F.concat(F.lit("rec_"), F.substring(F.sha2(key, 256), 1, 16))


def identity_key(email: Column, salt: str | None) -> Column:
    """The only form in which a user is stored: h1: and an HMAC-SHA256 under the salt, or s1: and a plain hash.

    HMAC out of SHA-256: the padded keys are literals, so it stays inside the JVM."""
    import hashlib

    norm = F.nullif(F.lower(stripped(email)), F.lit(""))
    if not salt:
        return F.concat(F.lit("s1:"), F.sha2(F.concat(F.lit("scholia-live:"), norm), 256))
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(k ^ 0x36 for k in key)), norm.cast("binary")), 256)
    outer = F.sha2(F.concat(F.lit(bytes(k ^ 0x5C for k in key)), F.unhex(inner)), 256)
    return F.when(norm.isNotNull(), F.concat(F.lit("h1:"), outer))
