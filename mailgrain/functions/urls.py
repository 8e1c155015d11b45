"""URL extraction, splitting, joining and host tests as native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.  Matching ignores case, and Unicode case folding adds four
# letters to a-z; they are spelled out so every regex engine agrees.
FOLDED = r"\x{130}\x{131}\x{17f}\x{212a}"
ALNUM = rf"a-zA-Z0-9{FOLDED}"
URL_CHARS = rf"[!$-_a-z{FOLDED}]"
URL_PATTERNS = (
    rf"[hH][tT][tT][pP][sS\x{{17f}}]?://{URL_CHARS}+",
    rf"[wW][wW][wW]\.{URL_CHARS}+",
    rf"[{ALNUM}][{ALNUM}-]{{1,61}}[{ALNUM}]\.[a-zA-Z{FOLDED}]{{2,}}",
)
# Schemes whose last path segment may carry parameters.
PARAM_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips",
                 "mms", "sftp", "tel")
DOMAIN_END = rf"\.[a-zA-Z{FOLDED}]{{2}}"

# inet_aton number forms, already limited to 32 bits by digit count.
_HEX = r"0x0*[0-9a-f]{1,8}"
_OCT = r"00*[0-7]{0,11}"
_DEC = r"[1-9][0-9]{0,9}"
_NUMBER = f"(?:{_HEX}|{_OCT}|{_DEC})"
_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PAIR = "[0-9a-fA-F]{1,4}"
_LAST = rf"(?:{_PAIR}:{_PAIR}|{_BYTE}(?:\.{_BYTE}){{3}})"
# Eight groups; "::" stands for one or more missing ones, n of them before it.
_IPV6 = "|".join([
    f"(?:{_PAIR}:){{6}}{_LAST}",
    *(f"(?:(?:{_PAIR}:){{0,{n - 1}}}{_PAIR})?::(?:{_PAIR}:){{{5 - n}}}{_LAST}" if n else f"::(?:{_PAIR}:){{5}}{_LAST}" for n in range(6)),
    f"(?:(?:{_PAIR}:){{0,5}}{_PAIR})?::{_PAIR}", f"(?:(?:{_PAIR}:){{0,6}}{_PAIR})?::"])
IPV6_FORM = rf"\A(?:(?:{_IPV6})(?:%[^%]+)?|v[a-fA-F0-9]+\..+)\z"
IPV4_FORM = rf"\A{_NUMBER}(?:\.{_NUMBER}){{0,3}}\z"


def extract_urls(text: Column) -> Column:
    """Distinct URLs of a text; null text gives an empty array.

    Three searches over the whole text: full URLs, ``www.`` hosts and bare
    domains.  A hit that does not start with lower-case ``http(s)://`` gets an
    ``https://`` prefix.  Cheap tests skip the searches that cannot succeed.
    """
    none = F.array().cast("array<string>")
    possible = (text.contains("://"), text.rlike(r"[wW]{3}\."), text.rlike(DOMAIN_END))
    found = F.concat(*[
        F.when(test, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
        for test, pattern in zip(possible, URL_PATTERNS)])
    absolute = F.transform(
        found,
        lambda u: F.when(u.startswith("http://") | u.startswith("https://"), u)
        .otherwise(F.concat(F.lit("https://"), u)),
    )
    return F.array_distinct(absolute)


@dataclass(frozen=True)
class UrlParts:
    """Column expressions for the parts of one URL column."""

    scheme: Column
    netloc: Column
    path: Column
    params: Column
    query: Column
    fragment: Column
    malformed: Column

    @property
    def host(self) -> Column:
        return F.lower(self.netloc)


_CLEANED = r"\A[\x00-\x20]+|[\t\r\n]+"
_SCHEME = r"\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?"
_SPLIT = _SCHEME + r"(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?\z"


def has_bad_brackets(netloc: Column) -> Column:
    """Whether brackets in an authority are anything but one whole IPv6 (or future) literal as the host."""
    inside = F.regexp_extract(netloc, r"\A(?:[^\[\]]*@)?\[([^\[\]]*)\](?::[^\[\]]*)?\z", 1)
    return F.when(netloc.contains("[") | netloc.contains("]"), ~inside.rlike(IPV6_FORM)).otherwise(F.lit(False))


def split_url(url: Column) -> UrlParts:
    """Split by the generic URI grammar; ``netloc`` keeps port and user info.

    ``;params`` of the last path segment are split off.  Brackets in the
    authority that are not one valid host literal mark the URL as malformed.
    """
    clean = F.regexp_replace(url, _CLEANED, "")
    part = lambda n: F.regexp_extract(clean, _SPLIT, n)
    netloc = part(2)
    full_path = part(3)
    scheme = F.lower(part(1))
    path = F.when(
        scheme.isin(*PARAM_SCHEMES), F.regexp_extract(full_path, r"\A((?:.*/)?[^/;]*)", 1)
    ).otherwise(full_path)
    return UrlParts(
        scheme=scheme,
        netloc=netloc,
        path=path,
        params=F.substr(full_path, F.length(path) + 2),
        query=part(4),
        fragment=part(5),
        malformed=has_bad_brackets(netloc),
    )


def is_ipv4_literal(host: Column) -> Column:
    """Whether ``inet_aton`` would accept the lower-case host.

    One to four numbers in decimal, octal or hex; each but the last is one
    byte, the last fills the remaining bytes.
    """
    digits = F.split(host, r"\.")
    numbers = F.transform(
        digits,
        lambda d: F.when(d.startswith("0x"), F.conv(F.substr(d, F.lit(3)), 16, 10))
        .when(d.startswith("0"), F.conv(d, 8, 10)).otherwise(d).cast("bigint"))
    count = F.size(numbers)
    leading = F.forall(F.slice(numbers, F.lit(1), count - 1), lambda n: n <= 255)
    last = F.element_at(numbers, -1) < F.pow(F.lit(256), 5 - count)
    return F.when(host.rlike(IPV4_FORM), leading & last).otherwise(F.lit(False))


def _without_dots(segments: Column) -> Column:
    """Resolve ``.`` and ``..`` in an array of path segments."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg))),
    )
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)


def resolve_location(base: Column, location: Column) -> Column:
    """Absolute form of a redirect target.

    A location starting with ``http`` is used as it is; any other is resolved
    against the URL that answered.
    """
    b, loc = split_url(base), split_url(location)
    with_params = lambda p, s: F.concat(
        p, F.when(s != "", F.concat(F.lit(";"), s)).otherwise(F.lit("")))
    suffix = lambda mark, s: F.when(
        s != "", F.concat(F.lit(mark), s)).otherwise(F.lit(""))

    base_segments = F.split(b.path, "/")
    base_dir = F.when(
        F.element_at(base_segments, -1) != "",
        F.slice(base_segments, F.lit(1), F.size(base_segments) - 1),
    ).otherwise(base_segments)
    own = F.split(loc.path, "/")
    # Below the base directory empty segments survive only at both ends.
    below = F.concat(base_dir, own)
    size = F.size(below)
    tidy = F.filter(below, lambda s, i: (i == 0) | (i == size - 1) | (s != ""))
    kept = F.when(loc.path.startswith("/"), own).otherwise(tidy)
    merged = F.array_join(_without_dots(kept), "/")
    rooted = F.when(merged.startswith("/"), merged).otherwise(F.concat(F.lit("/"), merged))

    no_path = (loc.path == "") & (loc.params == "")
    path = F.when(no_path, with_params(b.path, b.params)).otherwise(
        with_params(rooted, loc.params))
    query = F.when(no_path & (loc.query == ""), b.query).otherwise(loc.query)
    origin = F.concat(b.scheme, F.lit("://"))
    relative = F.concat(origin, b.netloc, path, suffix("?", query),
                        suffix("#", loc.fragment))
    same_scheme = F.concat(origin, loc.netloc, with_params(loc.path, loc.params),
                           suffix("?", loc.query), suffix("#", loc.fragment))
    return (
        F.when(location.startswith("http"), location)
        .when((loc.scheme != "") & (loc.scheme != b.scheme), location)
        .when(loc.netloc != "", same_scheme)
        .otherwise(relative)
    )
