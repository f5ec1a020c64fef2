"""URL, HTML and text expressions. All of them stay on the JVM side."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named characters of HTML, from the standard library: names that end in ';', and the older ones that need none.
_NAMED = json.dumps(html5)
_UNCLOSED = json.dumps({name: char for name, char in html5.items() if not name.endswith(";")})
_LONGEST_UNCLOSED = max(len(name) for name in html5 if not name.endswith(";"))
# Numbers 128 to 159 mean what the Windows character set has there.
_WINDOWS = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160))
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)"

# Fixed value: length of the stored snippet.
SNIPPET_CHARS = 500

_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
_HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and bind it inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _numbered(digits: Column, base: int) -> Column:
    """Character of a number; the replacement character for zero, surrogates and what is beyond Unicode."""
    def char(short: Column) -> Column:
        number = F.conv(short, base, 10).cast("bigint")
        wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return (F.when(F.length(short) > 7, "\ufffd")
                .when((short == "") | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd")
                .when(number.between(128, 159), F.substr(F.lit(_WINDOWS), number.cast("int") - 127, F.lit(1)))
                .otherwise(wide))

    return let(F.regexp_replace(digits, "^0+", ""), char)


def _entity(token: Column, closed_only: bool) -> Column:
    """Text of one character reference, or the reference itself where it names nothing."""
    named = F.from_json(F.lit(_NAMED), "map<string,string>")
    unclosed = F.from_json(F.lit(_UNCLOSED), "map<string,string>")
    name = F.substr(token, F.lit(2))
    body = F.regexp_replace(token, ";$", "")
    # the longest older name that the reference starts with
    lengths = F.filter(F.sequence(F.lit(_LONGEST_UNCLOSED), F.lit(2), F.lit(-1)),
                       lambda n: F.map_contains_key(unclosed, F.substr(name, F.lit(1), n)))
    prefix = let(lengths, lambda hit: F.when(F.size(hit) > 0, F.concat(
        F.element_at(unclosed, F.substr(name, F.lit(1), F.get(hit, 0))), F.substr(name, F.get(hit, 0) + 1))).otherwise(token))
    word = F.coalesce(F.try_element_at(named, name), F.lit(None) if closed_only else prefix, token)
    known = (F.when(token.rlike("^&#[xX]"), _numbered(F.substr(body, F.lit(4)), 16))
             .when(token.startswith("&#"), _numbered(F.substr(body, F.lit(3)), 10)).otherwise(word))
    return F.when(token.endswith(";"), known).otherwise(token) if closed_only else known


def decode_entities(text: Column, closed_only: bool = False) -> Column:
    """``text`` with character references replaced in one pass, so that what they give is not read again.

    ``closed_only`` leaves references without ';' alone, as addresses hold '&name=' for other reasons.
    """
    tokens = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    chars = F.transform(tokens, lambda t: _entity(t, closed_only))
    between = F.split(text, _ENTITY, -1)
    joined = let(chars, lambda c: F.array_join(F.transform(
        between, lambda part, i: F.concat(part, F.coalesce(F.get(c, i), F.lit("")))), ""))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def squeeze(text: Column) -> Column:
    """Collapse white space (with no-break space) and trim."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def _visible(html: Column) -> Column:
    return squeeze(let(F.regexp_replace(html, "<[^>]*>", " "), lambda t: decode_entities(t)))


def html_title(html: Column) -> Column:
    """Text of ``<title>``; the first ``<h1>`` when the title is missing or blank."""
    title = _visible(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    heading = _visible(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return F.coalesce(F.nullif(title, F.lit("")), heading)


def html_text(html: Column) -> Column:
    """Visible text: no head, scripts, styles, comments or tags."""
    body = html
    for tag in ("head", "script", "style", "noscript", "template"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    return _visible(body)


def domain_of(url: Column) -> Column:
    """Network location of a URL, kept as written; '' when there is none."""
    return F.regexp_extract(url, _NETLOC, 1)


def page_id(url: Column) -> Column:
    return F.md5(url)


def snippet(content: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.substring(content, 1, chars)


def ingest_ts() -> Column:
    return F.current_timestamp()


def embed_text(title: Column, content: Column) -> Column:
    """Whole text that is embedded."""
    blank = F.lit("")
    return F.concat_ws("\n\n", F.coalesce(title, blank), F.coalesce(content, blank))


def hrefs(html: Column) -> Column:
    """Link targets of a page, quoted or not, in document order."""
    found = F.regexp_extract_all(html, F.lit(_HREF), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, """^["']|["']$""", ""))


def remove_dots(path: Column) -> Column:
    """An absolute path without its '.' and '..' segments; '..' at the root leads nowhere."""
    def folded(parts: Column) -> Column:
        start = F.array().cast("array<string>")
        kept = F.aggregate(
            F.slice(parts, 2, F.size(parts)), start,
            lambda acc, part: F.when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(part == ".", acc).otherwise(F.concat(acc, F.array(part))))
        last = F.element_at(parts, -1)
        kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return F.concat(F.lit("/"), F.array_join(kept, "/"))

    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), let(F.split(path, "/"), folded)).otherwise(path)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` on page ``base`` without its fragment, '.' and '..' resolved.

    NULL for in-page anchors, empty links and non-http schemes.
    """
    link = F.regexp_replace(let(F.trim(href), lambda t: decode_entities(t, closed_only=True)), "#.*$", "")
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)

    def clean(url: Column) -> Column:
        place = F.regexp_extract(url, r"^([^?]*?://[^/?]*)", 1)
        own = F.regexp_extract(url, r"^[^?]*?://[^/?]*([^?]*)", 1)
        return F.when(own.contains("/."), F.concat(
            place, remove_dots(own), F.regexp_extract(url, r"(\?.*)$", 1))).otherwise(url)

    return let(let(link, lambda u: (
        F.when(u == "", None)
        .when(u.rlike("^(?i)https?://"), u)
        .when(u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(u.startswith("//"), F.concat(scheme, u))
        .when(u.startswith("/"), F.concat(site, u))
        .when(u.startswith("?"), F.concat(site, path, u))
        .otherwise(F.concat(site, folder, u))
    )), clean)
