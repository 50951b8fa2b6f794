"""Redaction and clean-up of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is redacted, and how characters are spelt in plain Latin-1.
REDACTED = "***REDACTED***"
REDACT_PATTERNS = (
    r"(Bearer\s+)[A-Za-z0-9\-\._~\+\/]+=*",
    r"(Authorization['\"]?\s*[:=]\s*['\"]?)[^'\"\s,}]+",
    r"(access_token['\"]?\s*[:=]\s*['\"]?)[^'\"\s,}]+",
    r"(token['\"]?\s*[:=]\s*['\"]?)[A-Za-z0-9\-\._~\+\/]{12,}=*",
    r"(api[_-]?key['\"]?\s*[:=]\s*['\"]?)[A-Za-z0-9\-\._~\+\/]{8,}",
    r"()\b[a-f0-9]{32}-[a-f0-9]{32}\b",
)
ACCENTED = "àâäáãèéêëîïíìôöóòõùûüúçñÀÂÄÁÈÉÊËÎÏÍÔÖÓÙÛÜÚÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAEEEEIIIOOOUUUUCN"
SYMBOL_TAGS = (("🟢", "[BUY]"), ("🔴", "[SELL]"), ("🔥", "[CHAUD]"), ("↔️", "[PIVOT]"), ("↔", "[PIVOT]"), ("⚠️", "[PROCHE]"), ("⚠", "[PROCHE]"))


def redact(text: Column) -> Column:
    """Secrets give way to a mark; what introduces them stays."""
    for pattern in REDACT_PATTERNS:
        text = F.regexp_replace(text, f"(?i){pattern}", f"$1{REDACTED}")
    return text


def redact_all(values: Column) -> Column:
    """redact() for every element of an array."""
    return F.transform(values, redact)


def redact_map(values: Column) -> Column:
    """redact() for every value of a map."""
    return F.transform_values(values, lambda _, v: redact(v))


def latin_text(text: Column, longest: int = 200) -> Column:
    """Text that a Latin-1 document can show, cut to `longest` characters; null is empty."""
    out = F.translate(F.coalesce(text, F.lit("")), ACCENTED, PLAIN)
    for symbol, tag in SYMBOL_TAGS:
        out = F.replace(out, F.lit(symbol), F.lit(tag))
    out = F.regexp_replace(out, "[^\\x{0}-\\x{FF}]", "?")
    return F.when(F.length(out) > longest, F.concat(F.substring(out, 1, longest - 3), F.lit("..."))).otherwise(out)
