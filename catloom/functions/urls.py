"""URL columns: canonical forms, parts, slugs, pages and variations. All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page-number forms in links and markup (fixed values).
PAGE_PATTERNS = (r"[?&]page=(\d+)", r"[?&]p=(\d+)", r"/page/(\d+)", r"/p/(\d+)", r"[?&]pagina=(\d+)")
#: Endings of files that are no pages, and words of pages that are no content (fixed values).
STATIC_ENDINGS = (".jpg", ".png", ".pdf", ".zip", ".css", ".js")
UTILITY_WORDS = ("login", "cadastro", "cart", "checkout", "conta", "minha-conta")


def canonical(url: Column, cut_fragment: bool = True) -> Column:
    """Without query, fragment and trailing slashes; ``cut_fragment=False`` keeps the fragment."""
    bare = F.substring_index(url, "?", 1)
    return F.rtrim(F.substring_index(bare, "#", 1) if cut_fragment else bare, F.lit("/"))


def compare_key(url: Column) -> Column:
    """Trimmed, lower-case, without trailing slashes."""
    return F.lower(F.rtrim(F.trim(url), F.lit("/")))


def authority(url: Column) -> Column:
    """Host with port; null for what is no URL."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def depth(url: Column) -> Column:
    return F.size(segments(url))


def slash_count(url: Column) -> Column:
    """All slashes, the two of the scheme included."""
    return F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))


def title_case(text: Column) -> Column:
    """Each run of letters starts with a capital, after digits and signs too (``12v`` becomes ``12V``)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def slug_name(url: Column, which: str = "last") -> Column:
    """A name from the path: hyphens to blanks, title case.

    ``last``: the last part; ``before_p``: the one before a final ``/p``;
    ``second_last``: the one before last unless shorter than 3.
    """
    parts = F.split(url, "/")
    last, previous = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    if which == "before_p":
        last = F.when((last == "p") & previous.isNotNull(), previous).otherwise(last)
    elif which == "second_last":
        last = F.when(F.length(F.coalesce(previous, F.lit(""))) >= 3, previous).otherwise(last)
    return title_case(F.replace(last, F.lit("-"), F.lit(" ")))


def trailing_id(url: Column) -> Column:
    """Digits that end the URL."""
    found = F.regexp_extract(url, r"(\d+)/?$", 1)
    return F.when(found != "", found)


def hyphen_id(url: Column) -> Column:
    """Digits after the last hyphen that end the URL."""
    found = F.regexp_extract(url, r"-(\d+)$", 1)
    return F.when(found != "", found)


def variations(url: Column) -> Column:
    """The URL and its forms under ``/produto/``, ``/product/`` and ``/p/``, in order, each once."""
    root = F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), authority(url))
    rest = F.ltrim(path(url), F.lit("/"))
    return F.array_distinct(F.array(url, *[F.concat(root, F.lit(p), rest) for p in ("/produto/", "/product/", "/p/")]))


def with_prefix(url: Column, prefix: Column) -> Column:
    """``prefix`` (without slashes) after the host, unless the path has it already."""
    root = F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), authority(url))
    has = F.contains(path(url), F.concat(F.lit("/"), prefix, F.lit("/")))
    return F.when(has, url).otherwise(F.concat(root, F.lit("/"), prefix, path(url)))


def next_page(url: Column) -> Column:
    """The URL with its ``page`` parameter one higher; null without one."""
    page = F.try_parse_url(url, F.lit("QUERY"), F.lit("page")).try_cast("int")
    higher = F.concat(F.lit("$1"), (page + 1).cast("string"))
    return F.when(page.isNotNull(), F.regexp_replace(url, F.lit(r"([?&]page=)\d+"), higher))


def page_numbers(text: Column) -> Column:
    """Distinct page numbers in any of the known forms, ascending."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PAGE_PATTERNS]))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.try_cast("bigint"))))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on the page ``base``, ``..`` and ``.`` removed (RFC 3986, section 5.2)."""
    scheme = F.try_parse_url(base, F.lit("PROTOCOL"))
    root = F.concat(scheme, F.lit("://"), authority(base))
    folder = F.coalesce(F.nullif(F.regexp_extract(path(base), r"^(.*/)[^/]*$", 1), F.lit("")), F.lit("/"))
    bare = F.regexp_extract(base, r"^[^?#]*", 0)
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.substring_index(base, "#", 1), href))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(root, folder, href))
    )
    head = F.regexp_extract(joined, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    tail = F.substring(joined, F.length(head) + 1, F.length(joined))
    own_path, rest = F.regexp_extract(tail, r"^[^?#]*", 0), F.regexp_extract(tail, r"[?#].*$", 0)
    steps = F.aggregate(
        F.split(own_path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    ends_in_dots = own_path.rlike(r"/\.{1,2}$")
    flat = F.concat(F.array_join(steps, "/"), F.when(ends_in_dots, F.lit("/")).otherwise(F.lit("")))
    return F.when((head != "") & F.contains(own_path, F.lit("/.")), F.concat(head, flat, rest)).otherwise(joined)


def crawlable(url: Column, site: Column) -> Column:
    """Same host as ``site``, no fragment, no static file, no utility page."""
    low = F.lower(url)
    static = F.lit(False)
    for e in STATIC_ENDINGS:
        static = static | low.endswith(e)
    return (F.coalesce(authority(url) == site, F.lit(False))) & ~url.contains("#") & ~static & ~low.rlike("|".join(UTILITY_WORDS))
