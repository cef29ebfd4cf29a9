"""Redaction of addresses and secrets in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_origin(url: Column) -> Column:
    """Scheme and host of a URL in lower case; null for text that isn't one."""
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"), F.lower(F.regexp_extract(F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@\s]*@", "$1"), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+)", 1)))


def redact_text(text: Column) -> Column:
    """Mask URLs, bearer tokens, key assignments and 32-byte hexadecimal values."""
    text = F.regexp_replace(text, r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+", "<url>")
    text = F.regexp_replace(text, r"(?i)\bbearer\s+[^\s\"']+", "<token>")
    text = F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password)\b(\s*[=:]\s*)[^\s,;\"']+", "$1$2<redacted>")
    return F.regexp_replace(text, r"(?i)\b(0x)?[0-9a-f]{64}\b", "<hex>")
