"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.text import alnum

_URL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$"

# Folders and extensions of files that are no pages.
ASSET_PREFIXES = ("/img/", "/images/", "/contentimages/", "/productimages/", "/js/", "/css/", "/fonts/", "/assets/", "/static/")
ASSET_EXTENSIONS = ".js .css .png .jpg .jpeg .gif .webp .svg .ico .woff .woff2 .ttf .otf .eot .map .pdf .zip .gz .mp4 .mov .webm .mp3 .wav".split()
# Media types besides text/* that can be indexed.
TEXT_TYPES = ("application/xhtml+xml", "application/xml", "application/rss+xml", "application/atom+xml", "application/json", "application/ld+json")


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with ?, 5 fragment with #; empty if absent or no absolute url."""
    return F.regexp_extract(url, _URL, group)


def host(url: Column) -> Column:
    """Lower-cased host without user part and port; empty if there is none."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), "^[^@]*@", ""), ":[0-9]*$", "")


def normalize_url(url: Column) -> Column:
    """No fragment, scheme and host in lower case, no default port, one trailing slash of the path removed unless the
    path is just that. What is no absolute url stays as it is."""
    scheme, authority, path = F.lower(part(url, 1)), F.lower(part(url, 2)), part(url, 3)
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    return F.when(url.rlike(_URL), F.concat(scheme, F.lit("://"), authority, path, part(url, 4))).otherwise(url)


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def domain(url: Column) -> Column:
    """Host with port; the url itself if it has none."""
    return F.coalesce(F.nullif(part(url, 2), F.lit("")), url)


def in_domains(name: Column, allowed: list[str]) -> Column:
    """Whether a host is one of the domains or below one, in any case; no domains allow all."""
    if not allowed:
        return F.lit(True)
    low = F.lower(name)
    return F.exists(F.array(*[F.lit(a.lower()) for a in allowed]), lambda a: (low == a) | F.endswith(low, F.concat(F.lit("."), a)))


def host_matches(name: Column, target: str) -> Column:
    """Equal or below after trimming, lower-casing and dropping dots at the end. Nothing matches an empty side."""
    low = F.regexp_replace(F.lower(F.trim(name)), "\\.+$", "")
    aim = target.strip().lower().rstrip(".")
    return F.lit(False) if not aim else (low == aim) | F.endswith(low, F.lit("." + aim))


def normalize_domain(text: str) -> str:
    """Host of what a user typed as a domain; ValueError if there is none."""
    from urllib.parse import urlsplit

    text = text.strip()
    if not text:
        raise ValueError("domain cannot be empty")
    try:
        name = urlsplit(text if "://" in text else f"https://{text}").hostname
    except ValueError as e:
        raise ValueError(f"invalid domain {text!r}") from e
    name = (name or "").strip().lower().rstrip(".")
    if not name:
        raise ValueError(f"no host in {text!r}")
    return name


def disallowed(path: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(path, p)) if prefixes else F.lit(False)


def text_like(content_type: Column) -> Column:
    """Whether a media type can be indexed; a missing one can."""
    kind = F.trim(F.element_at(F.split(F.lower(F.trim(F.coalesce(content_type, F.lit("")))), ";"), 1))
    return (kind == "") | F.startswith(kind, F.lit("text/")) | kind.isin(*TEXT_TYPES)


def navigable(url: Column) -> Column:
    """Not below an asset folder and without an asset's extension."""
    path = F.lower(F.trim(part(url, 3)))
    ext = F.regexp_extract(path, "(\\.[^./]*)$", 1)
    return ~path.rlike(f"^({'|'.join(ASSET_PREFIXES)})") & ~ext.isin(*ASSET_EXTENSIONS)


def _without_dots(path: Column) -> Column:
    """Path with . and .. segments resolved."""
    segments = F.split(path, "/")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segments,
        empty,
        lambda done, s: F.when(s == ".", done).when(s == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)).otherwise(F.concat(done, F.array(s))),
    )
    ends = F.when(path.rlike("/\\.\\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.array_join(folded, "/"), ends)).otherwise(path)


def resolve(link: Column, page: Column) -> Column:
    """A link as an absolute http or https url, seen from its page; null if it is none."""
    link = F.trim(link)
    scheme, origin = part(page, 1), F.concat(part(page, 1), F.lit("://"), part(page, 2))
    folder = F.regexp_replace(part(page, 3), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path, rest = F.regexp_extract(link, "^([^?#]*)", 1), F.regexp_extract(link, "^[^?#]*(.*)$", 1)
    joined = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, _without_dots(path), rest))
        .when(F.startswith(link, F.lit("?")), F.concat(origin, part(page, 3), link))
        .when(F.startswith(link, F.lit("#")), F.concat(origin, part(page, 3), part(page, 4), link))
        .when(link == "", page)
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest))
    )
    return F.when(joined.rlike("(?i)^https?://"), joined)


def anchor_links(html: Column, page: Column) -> Column:
    """Normalised targets of the anchors of a page, in order, each once."""
    hrefs = F.regexp_extract_all(html, F.lit("(?i)<a[ \\t\\n][^>]*?href[ ]*=[ ]*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(F.transform(hrefs, lambda x: resolve(x, page)), lambda x: x.isNotNull()), normalize_url))


def embedded_links(text: Column, page: Column) -> Column:
    """Normalised pages among the quoted addresses and root paths of scripts and data, in order, each once."""
    quoted = F.regexp_extract_all(text, F.lit("[\"']((?:https?:)?(?:\\\\?/){1,2}[A-Za-z0-9_.~:/?#@!$&*+,;=%\\\\-]+)[\"']"), F.lit(1))
    plain = F.transform(quoted, lambda x: F.replace(x, F.lit("\\/"), F.lit("/")))
    found = F.filter(F.transform(plain, lambda x: resolve(x, page)), lambda x: x.isNotNull() & navigable(x))
    return F.array_distinct(F.transform(found, normalize_url))


def url_depth(url: Column) -> Column:
    """Slashes after :// over the whole rest of the string; without :// none."""
    rest = F.regexp_extract(url, "^.*?://(.*)$", 1)
    return F.length(rest) - F.length(F.replace(rest, F.lit("/"), F.lit("")))


def is_homepage(url: Column) -> Column:
    return part(url, 3).isin("", "/")


def host_label(url: Column) -> Column:
    """First label of the host besides www, letters and digits only."""
    labels = F.filter(F.split(F.trim(host(url)), "\\."), lambda x: F.trim(x) != "")
    labels = F.when(F.get(labels, F.lit(0)) == "www", F.slice(labels, 2, 100)).otherwise(labels)
    return F.coalesce(alnum(F.get(labels, F.lit(0))), F.lit(""))


def slug(url: Column) -> Column:
    """Path as words joined by hyphens; index for an empty one."""
    words = F.transform(F.split(part(url, 3), "/"), lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(F.array_join(F.filter(words, lambda x: x != ""), "-"), F.lit("")), F.lit("index"))


def export_name(url: Column, doc_id: Column) -> Column:
    prefix = F.coalesce(F.nullif(F.substring(F.trim(doc_id), 1, 12), F.lit("")), F.lit("unknown"))
    return F.concat(slug(url), F.lit("-"), prefix, F.lit(".md"))
