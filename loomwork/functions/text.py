"""Text functions over pages: hashes, names, links. All are column expressions."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"\[\[([^\]\|]+)(?:\|[^\]]+)?\]\]"
#: Front-matter fields that hold links.
LINK_FIELDS = ("cross_references", "sources", "evidence", "cites")
SCHEME = "wiki://"


def content_hash(text: str | Column) -> Column:
    return F.sha2(text if isinstance(text, Column) else F.col(text), 256)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^(?U:\s)+|(?U:\s)+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def trim_chars(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))


def slugify(c: Column, longest: int = 60) -> Column:
    return F.substring(trim_chars(F.regexp_replace(F.lower(strip(c)), "[^a-zA-Z0-9_-]+", "-"), "-"), 1, longest)


def archetype_id(category: Column, query: Column) -> Column:
    return F.concat(category, F.lit("--"), slugify(F.substring(query, 1, 60)))


def index_name(c: Column) -> Column:
    name = trim_chars(F.regexp_replace(F.lower(c), "[^a-z0-9-]+", "-"), "-")
    name = F.when(name == "", F.lit("wiki")).otherwise(name)
    return trim_chars(F.substring(name, 1, 45), "-")


def safe_path(c: Column) -> Column:
    name = trim_chars(F.regexp_replace(c, "[^a-zA-Z0-9_./-]+", "-"), "-/")
    return F.when(name == "", F.lit("page")).otherwise(name)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def slug_to_uri(c: Column) -> Column:
    return F.concat(F.lit(SCHEME), F.replace(trim_chars(c, "/"), F.lit(" "), F.lit("%20")))


def uri_to_slug(c: Column) -> Column:
    rest = F.substring(c, len(SCHEME) + 1, 1 << 30)
    # a plus sign is itself here, not a space
    decoded = F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    slug = trim_chars(decoded, "/")
    return F.when(F.startswith(c, F.lit(SCHEME)) & (slug != ""), slug)


def parse_uri(uri: str) -> str | None:
    slug = unquote(uri.removeprefix(SCHEME)).strip("/") if uri.startswith(SCHEME) else ""
    return slug or None


# Characters that are shown of a page, embedded of a page without a vector, kept beside a vector.
SNIPPET, FRESH, STORED = 400, 1500, 8000


def snippet(c: Column, n: int = SNIPPET) -> Column:
    return F.substring(c, 1, n)


def fresh_passage(content: Column, n: int = FRESH) -> Column:
    """What is embedded of a page that has no vector yet; nothing of a page without content."""
    return F.substring(F.coalesce(content, F.lit("")), 1, n)


def body_links(body: Column) -> Column:
    """Targets of [[target|alias]], white space and leading slashes stripped, empties dropped, distinct."""
    found = F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(LINK), 1), lambda x: F.ltrim(strip(x), F.lit("/")))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def field_links(frontmatter: Column) -> Column:
    """Targets listed in front matter: strings lose what follows '#', objects give target or slug."""
    out = None
    for name in LINK_FIELDS:
        raw = F.coalesce(frontmatter[name], F.lit("[]"))
        items = F.coalesce(F.from_json(F.when(F.startswith(raw, F.lit("[")), raw).otherwise(F.lit("[]")), "array<string>"), F.array().cast("array<string>"))

        def one(x: Column) -> Column:
            obj = F.coalesce(F.get_json_object(x, "$.target"), F.get_json_object(x, "$.slug"))
            return strip(F.when(F.startswith(x, F.lit("{")), obj).otherwise(F.substring_index(x, "#", 1)))

        links = F.filter(F.transform(items, one), lambda x: F.coalesce(x, F.lit("")) != "")
        out = links if out is None else F.concat(out, links)
    return F.array_distinct(out)


def crossrefs(body: Column, frontmatter: Column | None = None) -> Column:
    links = body_links(body)
    return links if frontmatter is None else F.array_distinct(F.concat(field_links(frontmatter), links))
