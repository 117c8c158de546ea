"""Column functions over text: keys, ids, counts, tokens, titles, headers. No Python runs per row.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs that count as words: letters, digits and underscores, with inner quotes and hyphens.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_’'-]*[\p{L}\p{N}_])?"
#: Search tokens are ASCII; an inner apostrophe or hyphen joins two runs.
SEARCH_TOKEN = r"[a-zA-Z0-9]+(?:['’-][a-zA-Z0-9]+)?"
#: Search tokens of any script.
UNICODE_TOKEN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)?"
TOKENS_PER_WORD = 1.33
#: Types of sources that answer with JSON, the heading of a category, and site names after a title.
API_TYPES = ("sparql_json", "wikipedia_api")
CATEGORY_HEADING = "# Wikipedia Category Members"
TITLE_SUFFIXES = (r"\s+- Wikipedia$", r"\s+\|\s+PROV$")

#: Fields of a provenance header, in order.
HEADER_FIELDS = ("source_id", "source_url", "page_title", "licence", "licence_url", "retrieved", "content_hash_sha256", "http_status")
#: Fields without which a header is invalid.
REQUIRED_FIELDS = ("source_id", "source_url", "page_title", "licence", "retrieved", "content_hash_sha256", "http_status")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def casefold(c: Column | str) -> Column:
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def normalise_key(c: Column | str) -> Column:
    """Case-folded, with straight apostrophes; other marks than - and ' become spaces."""
    return squeeze(F.regexp_replace(F.replace(casefold(c), F.lit("’"), F.lit("'")), r"[^\p{L}\p{N}_\s'-]", " "))


def stable_id(prefix: str, *parts: Column | str, normalise: bool = True) -> Column:
    """prefix_ and 16 hex digits of SHA-256 over the (normalised) parts."""
    keys = [normalise_key(_col(p).cast("string")) if normalise else _col(p).cast("string") for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *keys), 256), 1, 16))


def fingerprint(c: Column | str) -> Column:
    return F.substring(F.sha2(_col(c), 256), 1, 16)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(WORD)).cast("long")


def approximate_tokens(words: Column) -> Column:
    return F.ceil(words * TOKENS_PER_WORD).cast("long")


def search_tokens(c: Column | str, unicode: bool = False) -> Column:
    found = F.regexp_extract_all(_col(c), F.lit(UNICODE_TOKEN if unicode else SEARCH_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.replace(F.lower(t), F.lit("’"), F.lit("'")))


def safe_filename(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^A-Za-z0-9_-]", "_")


def html_title(html: Column | str, source_type: Column | None = None) -> Column:
    """The first title; `(no title)` without one, `(API response)` for the API types of sources."""
    found = F.trim(F.regexp_extract(_col(html), r"(?i)<title[^>]*>([^<]+)</title>", 1))
    title = F.when(found == "", "(no title)").otherwise(found)
    return title if source_type is None else F.when(source_type.isin(*API_TYPES), "(API response)").otherwise(title)


def html_to_text(html: Column | str, drop_code: bool = True) -> Column:
    """Tags become spaces; scripts and styles go with their bodies unless drop_code is off. Patterns are fixed values."""
    c = _col(html)
    if drop_code:
        c = F.regexp_replace(c, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", "")
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def bindings_table(payload: Column | str) -> Column:
    """SPARQL JSON results as a Markdown table; columns are those of the first binding, without any it is empty."""
    rows = F.from_json(_col(payload), "results struct<bindings array<map<string,struct<value string>>>>")["results"]["bindings"]
    names = F.map_keys(F.get(rows, F.lit(0)))
    line = lambda row: F.array_join(F.transform(names, lambda n: F.coalesce(F.try_element_at(row, n)["value"], F.lit(""))), " | ")
    return F.when(F.size(rows) > 0, F.concat_ws("\n", F.array_join(names, " | "), F.array_join(F.transform(names, lambda _: F.lit("---")), " | "), F.array_join(F.transform(rows, line), "\n"))).otherwise("")


def category_list(payload: Column | str, heading: str = CATEGORY_HEADING) -> Column:
    """Titles of a category API answer as bullets under a heading and a blank line; without members it is empty."""
    members = F.from_json(_col(payload), "query struct<categorymembers array<struct<title string>>>")["query"]["categorymembers"]
    bullets = F.array_join(F.transform(members, lambda m: F.concat(F.lit("- "), F.coalesce(m["title"], F.lit("")))), "\n")
    return F.when(F.size(members) > 0, F.concat(F.lit(f"{heading}\n\n"), bullets)).otherwise("")


def provenance_header(**fields: Column | str) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(_col(fields[k]).cast("string"), F.lit(""))) for k in HEADER_FIELDS]
    return F.concat_ws("\n", F.lit("<!-- PROVENANCE"), *lines, F.lit("-->"))


def parse_provenance(markdown: Column | str) -> Column:
    """A struct of the header's fields, the body after it, and whether all required fields are there.

    The header's pattern is a fixed value.
    """
    head = F.regexp_extract(_col(markdown), r"(?s)\A<!-- PROVENANCE\s*\n(.*?)\n-->\s*", 1)
    body = F.regexp_replace(_col(markdown), r"(?s)\A<!-- PROVENANCE\s*\n(.*?)\n-->\s*", "")
    lines = F.filter(F.split(head, "\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    fields = F.map_from_arrays(keys, F.transform(keys, last))
    valid = (head != "") & F.forall(F.array(*map(F.lit, REQUIRED_FIELDS)), lambda k: F.exists(pairs, lambda p: p["key"] == k))
    return F.struct(fields.alias("fields"), body.alias("body"), valid.alias("valid"))


def document_title(page_title: Column | str, source_id: Column | str, suffixes: tuple[str, ...] = TITLE_SUFFIXES) -> Column:
    """The page's title, else the source's id, else `Untitled`; site names at its end go, and white space around it."""
    title = F.coalesce(F.nullif(_col(page_title), F.lit("")), F.nullif(_col(source_id), F.lit("")), F.lit("Untitled"))
    for s in suffixes:
        title = F.regexp_replace(title, s, "")
    return F.regexp_replace(title, r"^\s+|\s+$", "")


def strip_markdown(c: Column | str) -> Column:
    """A line without images, link targets, footnote marks, tags and emphasis. The patterns are fixed values."""
    c = F.regexp_replace(_col(c), r"!\[[^\]]*\]\([^)]*\)", "")
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"(?i)\[(\d+|citation needed)\]", "")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    c = F.regexp_replace(c, r"\*\*|__|`", "")
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}_])[*_](?=\S)|(?<=\S)[*_](?![\p{L}\p{N}_])", "")
    return squeeze(c)


def clean_name(c: Column | str) -> Column:
    """A name without leading article and surrounding marks."""
    c = F.regexp_replace(F.trim(_col(c)), r"^(?:The|A|An)\s+", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "), F.lit(" ,.;:()[]"))


def duplicate_name_key(c: Column | str, places: tuple[str, ...] = ()) -> Column:
    """Letters and digits of the case-folded name, without a trailing place; null if under five characters."""
    key = F.regexp_replace(casefold(c), r"[^\p{L}\p{N}]", "")
    if places:
        key = F.regexp_replace(key, f"(?:{'|'.join(places)})$", "")
    return F.when(F.length(key) >= 5, key)


def child_id(parent: Column | str, index: Column | str, text: Column | str) -> Column:
    return stable_id("small", parent, index, text, normalise=False)


def valid_span(text: Column | str, start: Column | str, end: Column | str, supporting: Column | str) -> Column:
    """Does text[start:end], in code points, equal the supporting text?"""
    a, b = _col(start), _col(end)
    ok = (a >= 0) & (b > a) & (F.substr(_col(text), (a + 1).cast("int"), (b - a).cast("int")) == _col(supporting))
    return F.coalesce(ok, F.lit(False))


def evaluation_id(parent: Column | str, own: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(parent), F.lit("")), _col(own))


def confidence_badge(score: Column | str, threshold: Column | float) -> Column:
    s, t = _col(score), threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(s >= 2 * t, "High").when(s >= t, "Moderate").otherwise("Below threshold")


def coordinates(c: Column | str, pattern: str = r"(?<!\d)(-3[6-8]\.\d{3,8})\s*[;,]\s*(14[3-6]\.\d{3,8})(?!\d)") -> Column:
    """The first pair of latitude and longitude as [lon, lat], or null."""
    lat, lon = (F.nullif(F.regexp_extract(_col(c), pattern, k), F.lit("")).cast("double") for k in (1, 2))
    return F.when(lat.isNotNull(), F.array(lon, lat))
