"""URL expressions. All native, so filters on them stay inside the scan stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of a lower-cased URL that mark a PDF.
PDF_PATTERNS = (".pdf", "/pdf/", "application/pdf")

# URL schemes whose last path segment may carry ";params".
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps",
    "sip", "sips", "mms", "sftp", "tel",
)

# Scheme, network location and path, after any leading blanks.
_PARTS = r"(?s)^[\x00-\x20]*(?:([A-Za-z][A-Za-z0-9+.\-]*+):)?(?://([^/?#]*+))?([^?#]*+)"


def _part(url: Column | str, index: int) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    # Tabs and line breaks inside a URL do not count; few URLs have any.
    broken = url.contains("\t") | url.contains("\n") | url.contains("\r")
    tidy = F.when(broken, F.regexp_replace(url, r"[\t\r\n]", "")).otherwise(url)
    return F.coalesce(F.regexp_extract(tidy, _PARTS, index), F.lit(""))


def url_domain(url: Column | str) -> Column:
    """Network location with port, user info and case kept; '' when there is none."""
    return _part(url, 2)


def same_domain(url: Column | str, domain: Column | str) -> Column:
    """Exact equality of network locations; a subdomain is another domain."""
    return url_domain(url) == (domain if isinstance(domain, Column) else F.lit(domain))


def url_path(url: Column | str) -> Column:
    path = _part(url, 3)
    has_params = F.lower(_part(url, 1)).isin(*PARAM_SCHEMES)
    return F.when(has_params, F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)


def base_path(url: Column | str) -> Column:
    """The section a URL belongs to: its first two path segments, domain ignored."""
    return F.array_join(F.slice(F.split(url_path(url), "/"), 1, 3), "/")


def is_pdf_url(url: Column | str, patterns: Sequence[str] = PDF_PATTERNS) -> Column:
    """Whether the lower-cased URL contains one of ``patterns``."""
    lowered = F.lower(url)
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | lowered.contains(pattern)
    return F.coalesce(hit, F.lit(False))


def classify_document(url: Column | str) -> Column:
    return F.when(is_pdf_url(url), F.lit("pdf")).otherwise(F.lit("html"))


def url_hash(url: Column | str) -> Column:
    return F.md5(url)
