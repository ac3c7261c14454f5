"""Scrubbing connection data out of text (J9) and passwords out of URLs.

Column jobs: nested ``regexp_replace`` in a fixed order, plus per-rule match
counts.  The patterns are written with ASCII classes (``[\\t\\n\\f\\r ]``,
explicit word-boundary look-arounds) so Java's regex engine matches exactly
what an RE2-style engine does on accented text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = "A-Za-z0-9_"

# A host is sought once per run of its characters (or what a match left of it):
# the first letter or digit there reaches every dot that a later one would, so
# if it starts no host, none of the run does.  Each run is read once.
HOST_START = "(?:\\G|(?<![a-zA-Z0-9._-]))"

# Fixed scrub rules, applied in this order: (name, pattern, replacement).
SCRUB_RULES = [
    ("url", "postgres(?:ql)?://[^\\t\\n\\f\\r '\"]+", "postgres://<redacted>"),
    ("ip", f"(?<![{_W}])[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}(?::[0-9]+)?(?![{_W}])", "<ip>"),
    ("host", HOST_START + "([._-]*+)[a-zA-Z0-9][a-zA-Z0-9._-]*\\.(?:[a-zA-Z]{2,}|[a-zA-Z]+\\.[a-zA-Z]{2,})(?::[0-9]+)?", "$1<host>"),
    ("conn", "(?iu)`user=[^`]*`", "`<conn>`"),
]

# Fixed URL rules: an optional scheme, then the authority up to '/', '?' or
# '#'; user information ends at the last '@' of it, the user at the first ':'.
URL_AUTHORITY = r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//)"
URL_PASSWORD = URL_AUTHORITY + r"([^/?#:]*):[^/?#]*@"
URL_USER = URL_AUTHORITY + r"([^/?#]*)@"
URL_HOST = URL_AUTHORITY + r"(?:[^/?#]*@)?([^/?#]*)"
BAD_USER = r"[^A-Za-z0-9._:~!$&'()*+,;=%@-]"
BAD_PORT = r"^[^\[].*:[^:]*[^0-9:][^:]*$|^:[^:]*[^0-9:][^:]*$"
BAD_BRACKET = r"^\[([^\]]*$|.*\][^\]]*[^0-9:\]][^\]]*$|.*\][0-9])"
BAD_HOST = r"[ \\^`{|}]"
URL_BAD = r"[\x00-\x1f\x7f]|%(?![0-9A-Fa-f]{2})"
URL_NO_SCHEME = r"^[^/?#]*:"
URL_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scrub(text) -> Column:
    """All four replacements in order."""
    out = _c(text)
    for _, pat, rep in SCRUB_RULES:
        out = F.regexp_replace(out, pat, rep)
    return out


def scrub_stages(text) -> list[tuple[str, Column, Column]]:
    """(rule, matches of that rule at its turn, text after it) per rule."""
    out, stages = _c(text), []
    for name, pat, rep in SCRUB_RULES:
        stages.append((name, F.regexp_count(out, F.lit(pat)), F.regexp_replace(out, pat, rep)))
        out = stages[-1][2]
    return stages


def redact_url(url) -> Column:
    """The password becomes ***, the user stays (an '@' in it escaped).
    Text that is no URL -> '<redacted>': control characters, broken % escapes,
    a colon before any '/', '?' or '#' without a valid scheme, user information
    or a host with characters that cannot stand there, a port that is no
    number.  Without a password the text is unchanged."""
    u = _c(url)
    user, host = F.regexp_extract(u, URL_USER, 2), F.regexp_extract(u, URL_HOST, 2)
    bad = (u.rlike(URL_BAD) | (u.rlike(URL_NO_SCHEME) & ~u.rlike(URL_SCHEME)) | user.rlike(BAD_USER)
           | host.rlike(BAD_PORT) | host.rlike(BAD_BRACKET) | host.rlike(BAD_HOST))
    hidden = F.concat(F.regexp_extract(u, URL_PASSWORD, 1), F.replace(F.regexp_extract(u, URL_PASSWORD, 2), F.lit("@"), F.lit("%40")),
                      F.lit(":***@"), F.regexp_replace(u, URL_PASSWORD, ""))
    return F.when(bad, F.lit("<redacted>")).when(u.rlike(URL_PASSWORD), hidden).otherwise(u)
