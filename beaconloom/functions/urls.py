"""Hostnames and URL validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
AUTHORITY = rf"^(?:{SCHEME})?//([^/?#]*)"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"

USER_INFO = rf"^(?:{SCHEME})?//(?:[^/?#]*@)?+"

# Plain web URLs, by far the most, are settled by this one pattern.
PLAIN_URL = r"^https?://([A-Za-z0-9.\-]+)(?::[0-9]*)?(?:[/?#][A-Za-z0-9/._~\-?#&=+,;:@!$'()*]*)?\z"

# Each alternative is one way in which a URL cannot be read.
BAD_URL_PARTS = [
    r"[\x00-\x1F\x7F]",  # control character anywhere
    r"^:",  # nothing before the scheme's colon
    rf"^(?!{SCHEME})[^/?#][^/?#]*:",  # colon in the first segment of a relative path
    rf"^(?:{SCHEME})?/[^?#]*{BAD_ESCAPE}",  # broken escape in host or path
    rf"^(?!{SCHEME})[^?#]*{BAD_ESCAPE}",  # broken escape in a relative path
    rf"#.*{BAD_ESCAPE}",  # broken escape in the fragment
    rf"{USER_INFO}(?!\[)[^/?#]*:[^/?#:]*[^/?#:0-9][^/?#:]*(?:[/?#]|\z)",  # port that is not digits
    rf"{USER_INFO}\[[^/?#\]]*(?:[/?#]|\z)",  # bracket never closed
    rf"{USER_INFO}\[[^/?#\]]*\](?!(?::[0-9]*)?(?:[/?#]|\z))",  # text after the bracket
    rf"{USER_INFO}[^/?#]*[ \\^`{{|}}]",  # character not allowed in a host
    rf"{USER_INFO}[^/?#]*%(?!25)[0-7]",  # escaped ASCII in a host
    rf"^(?:{SCHEME})?//[^/?#]*[^/?#A-Za-z0-9\-._~:!$&'()*+,;=%@][^/?#]*@",  # bad user info
]
BAD_URL = "(?s)" + "|".join(f"(?:{part})" for part in BAD_URL_PARTS)


def plain_host(url: Column) -> Column:
    """Hostname of a plain web URL, which also is a readable one; ``''`` for all others."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PLAIN_URL, 1)


def is_bad_url(url: Column, plain: Column | None = None) -> Column:
    """True for a URL that cannot be parsed; the empty URL is fine."""
    plain = plain_host(url) if plain is None else plain
    return (plain == "") & F.coalesce(url, F.lit("")).rlike(BAD_URL)


def hostname(url: Column, plain: Column | None = None) -> Column:
    """Host without port, user info or IPv6 brackets; ``''`` if there is none.  Case is kept."""
    plain = plain_host(url) if plain is None else plain
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    host = F.when(
        host_port.startswith("["), F.regexp_extract(host_port, r"^\[(.*)\]", 1)
    ).otherwise(F.regexp_replace(host_port, r":[0-9]*\z", ""))
    decoded = F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)
    return (
        F.when(plain != "", plain).when(host.contains("%"), decoded).otherwise(host)
    )


def archive_host(host: Column) -> Column:
    """Directory name of a host: dots become underscores."""
    return F.replace(host, F.lit("."), F.lit("_"))
