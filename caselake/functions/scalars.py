"""Text, number, date, address and URL functions on Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import period_key, period_token, period_type, to_iso_date  # noqa: F401  part of this module's functions

#: Written forms of a missing value, beside blanks.
NULL_TOKENS = ("-", "n/a", "na", "none", "null")


def squeeze(col: Column) -> Column:
    """Trims and makes each run of white space one space."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def norm_text(col: Column) -> Column:
    """Squeezed text; written forms of a missing value become null."""
    text = squeeze(col)
    return F.when((text != "") & ~F.lower(text).isin(*NULL_TOKENS), text)


def to_number(col: Column) -> Column:
    """Number from text with thousands separators, currency signs or a percent sign at its end; null where it is none."""
    return F.regexp_replace(F.regexp_replace(norm_text(col), "[,£$€]", ""), "%$", "").try_cast("double")


def suppressed_number(col: Column) -> Column:
    """As :func:`to_number`; markers in brackets such as ``[c]`` are null, never 0."""
    return F.when(~F.coalesce(F.trim(col).rlike(r"^\["), F.lit(False)), to_number(col))


def year_of(col: Column) -> Column:
    """The first four characters where they are digits, else null."""
    return F.regexp_extract(col, r"^(\d{4})", 1).try_cast("int")


def days_between(start: Column, end: Column) -> Column:
    """Days between ISO dates in text; an invalid date gives null."""
    return F.datediff(end.try_cast("date"), start.try_cast("date"))


def slug(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def unique_names(names: Sequence[str]) -> list[str]:
    """Column names with a suffix for those seen before; blank ones are called ``column``."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        name = name or "column"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def reference_key(col: Column) -> Column:
    """Upper-cased, trimmed reference; blank and ``NAN`` become null."""
    key = F.upper(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.when(~key.isin("", "NAN"), key)


def reference_tail(col: Column) -> Column:
    """What follows the first slash, as a reference; without a slash the whole."""
    return reference_key(F.regexp_replace(col, r"^\s*[^/]*/", ""))


#: Words of an authority's name that do not tell it apart.
NAME_STOPWORDS = (
    "AND", "AUTHORITY", "BOROUGH", "CITY", "COUNCIL", "COUNTY", "DISTRICT", "LONDON", "METROPOLITAN", "OF", "ROYAL", "THE", "UNITARY",
)


def canonical_name(col: Column, stopwords: Sequence[str] = NAME_STOPWORDS, aliases: Mapping[str, str] | None = None) -> Column:
    """Upper-cased words of an organisation's name, in order, without ``stopwords``; ``&`` reads AND, ``ST`` reads SAINT.

    ``aliases`` maps such names to others, for instance to the authority that a merger made.  Without a word left: null.
    """
    text = F.regexp_replace(F.upper(col), "&", " AND ")
    words = F.split(F.regexp_replace(F.regexp_replace(text, r"\bST\b", "SAINT"), "[^A-Z0-9]+", " "), " ")
    name = F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*stopwords)), " ")
    if aliases:
        name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), name), name)
    return F.when(name != "", name)


def name_tokens(col: Column, **options) -> Column:
    """Sorted distinct words of :func:`canonical_name`; an empty array without one."""
    words = F.split(F.coalesce(canonical_name(col, **options), F.lit("")), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def is_token_subset(a: Column, b: Column) -> Column:
    """One token array holds the other, and neither is empty."""
    inside = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return (F.size(a) > 0) & (F.size(b) > 0) & inside


#: Area, district, sector and unit of a postcode, in capitals.
POSTCODE = r"\b([A-Z]{1,2}[0-9][0-9A-Z]?)\s*([0-9][A-Z]{2})\b"


def postcode(col: Column) -> Column:
    """First postcode of a text, its halves parted by one space; null where there is none."""
    text = F.upper(col)
    outward = F.regexp_extract(text, POSTCODE, 1)
    return F.when(outward != "", F.concat(outward, F.lit(" "), F.regexp_extract(text, POSTCODE, 2)))


def prefix_lookup(col: Column, mapping: dict[str, str], default: str = "Unknown") -> Column:
    """Region of a postcode area: its two-letter key if there is one, else its one-letter key."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    area = F.regexp_extract(F.upper(F.trim(col)), r"^([A-Z]{1,2})", 1)
    return F.coalesce(F.element_at(table, area), F.element_at(table, F.substring(area, 1, 1)), F.lit(default))


#: Words that open an address without telling it apart.
ADDRESS_NOISE = (
    "LAND", "AT", "OF", "REAR", "FRONT", "BEHIND", "FORMER", "NEXT", "NEAR", "OPPOSITE", "ADJACENT", "ADJOINING", "SITE", "THE", "SIDE", "TO",
    "ON", "RECEPTION", "PLOT", "UNIT",
)


def address_signature(col: Column, noise: Sequence[str] = ADDRESS_NOISE) -> Column:
    """First number of one to five digits, else the first word that is no noise word, in capitals; postcodes do not count."""
    tokens = F.regexp_extract_all(F.regexp_replace(F.upper(col), POSTCODE, ""), F.lit("[A-Z0-9]+"), F.lit(0))
    number = F.get(F.filter(tokens, lambda t: t.rlike("^[0-9]{1,5}$")), F.lit(0))
    word = F.get(F.filter(tokens, lambda t: ~t.isin(*noise)), F.lit(0))
    return F.coalesce(number, word)


def area_name_key(col: Column) -> Column:
    """Lower-cased area name without apostrophes, punctuation, and the usual prefixes and suffixes."""
    text = F.regexp_replace(F.lower(col), r"['’`]", "")
    text = F.regexp_replace(F.regexp_replace(text, "&", " and "), r"[^a-z0-9]+", " ")
    text = F.regexp_replace(F.trim(text), r"^(city of|county of|royal borough of|london borough of|the) ", "")
    text = F.regexp_replace(text, r" (city council|borough council|district council|county council|council|unitary authority)$", "")
    return F.trim(text)


def word_count(col: Column) -> Column:
    text = squeeze(F.coalesce(col, F.lit("")))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def text_quality(chars: Column, words: Column, hits: Column, pages: Column | None = None, short: int = 200, few_words: int = 40) -> Column:
    """unreadable / image_only / poor / good from the counts of an extracted text."""
    per_page = chars if pages is None else chars / F.greatest(pages, F.lit(1))
    return (
        F.when(F.coalesce(chars, F.lit(0)) == 0, "unreadable")
        .when(per_page < short, "image_only")
        .when((words < few_words) | (hits == 0), "poor")
        .otherwise("good")
    )


def section(col: Column, start: str, ends: Sequence[str], limit: int = 8000) -> Column:
    """Text after the first match of ``start``, at most ``limit`` characters, up to the first end anchor; null without a start."""
    rest = F.get(F.split(col, f"(?i){start}", 2), F.lit(1))
    body = F.substring(rest, 1, limit)
    for end in ends:
        body = F.get(F.split(body, f"(?i){end}", 2), F.lit(0))
    return F.trim(body)


def excerpt(col: Column, start: str, ends: Sequence[str], limit: int = 8000, head: int = 500) -> Column:
    """:func:`section`, or the head of the text where there is none."""
    found = section(col, start, ends, limit)
    return F.when(found != "", found).otherwise(F.substring(col, 1, head))


#: An entity: decimal, hexadecimal or named.
ENTITY = "&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def unescape(col: Column) -> Column:
    """Text with its entities resolved: decimal and hexadecimal ones, and the named ones of HTML 4 and ``&apos;``.

    Numbers 128 to 159 mean what they do in Windows code page 1252, as browsers read them; other names, and numbers that are no
    character, stay as they are.  Each entity is resolved once: ``&amp;lt;`` becomes ``&lt;``.
    """
    names = F.create_map(*[F.lit(x) for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (name, chr(code))])
    page = [(i, bytes([i]).decode("cp1252", "ignore")) for i in range(128, 160)]
    windows = F.create_map(*[F.lit(x) for i, sign in page if sign for x in (i, sign)])

    def sign(entity: Column) -> Column:
        digits = F.when(entity.rlike("^#[xX]"), F.conv(F.substring(entity, 3, 8), 16, 10)).when(entity.startswith("#"), F.substring(entity, 2, 8))
        code = digits.try_cast("int")
        fits = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        plain = F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        numbered = F.coalesce(F.try_element_at(windows, code), plain)
        return F.coalesce(F.when(entity.startswith("#"), numbered).otherwise(F.try_element_at(names, entity)), F.concat(F.lit("&"), entity, F.lit(";")))

    signs = F.transform(F.regexp_extract_all(col, F.lit(ENTITY), F.lit(1)), sign)
    between = F.split(col, ENTITY, -1)
    joined = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(signs, i), F.lit("")))), "")
    return F.when(F.contains(col, F.lit("&")), joined).otherwise(col)


def html_to_text(col: Column) -> Column:
    """Visible text: scripts and styles go, block tags break lines, other tags vanish, entities are resolved."""
    text = F.regexp_replace(col, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/table)[^>]*>", "\n")
    text = F.translate(unescape(F.regexp_replace(text, r"<[^>]+>", " ")), "\u00a0", " ")
    text = F.regexp_replace(text, r"[ \t\r]+", " ")
    return F.trim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"))


def url_host(col: Column) -> Column:
    """Lower-cased host; null for what is no URL."""
    return F.lower(F.try_parse_url(col, F.lit("HOST")))


def url_base(col: Column) -> Column:
    return F.concat(F.lower(F.try_parse_url(col, F.lit("PROTOCOL"))), F.lit("://"), url_host(col))


def rewrite_host(col: Column, hosts: dict[str, str]) -> Column:
    """Maps hosts and upgrades their scheme to https; user, port, path and other URLs stay. Idempotent."""
    if not hosts:
        return col
    table = F.create_map(*[F.lit(x) for kv in hosts.items() for x in (kv[0].lower(), kv[1])])
    new = F.element_at(table, url_host(col))
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/@?#]*@)?([^/:?#]+)(:[0-9]+)?(.*)$"
    rebuilt = F.concat(
        F.lit("https://"), F.regexp_extract(col, parts, 1), new, F.regexp_extract(col, parts, 3), F.regexp_extract(col, parts, 4)
    )
    return F.when(new.isNotNull(), rebuilt).otherwise(col)


def is_generic_url(
    col: Column,
    paths: Sequence[str] = ("", "/", "/home", "/index.html", "/search"),
    parts: Sequence[str] = ("login", "search.do"),
    fragments: Sequence[str] = ("advancedsearch",),
) -> Column:
    """A landing page: a generic path, a generic fragment, or a path that holds a generic part; false for null or blank."""
    path = F.lower(F.coalesce(F.try_parse_url(col, F.lit("PATH")), F.lit("")))
    bare = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    out = bare.isin(*paths) | F.lower(F.regexp_extract(col, "#(.*)$", 1)).isin(*fragments)
    for p in parts:
        out = out | path.contains(p)
    return F.coalesce(out & (F.trim(col) != ""), F.lit(False))


def resolve_url(base: Column, reference: Column) -> Column:
    """Address that a reference on page ``base`` means.

    Absolute addresses stay; ``//host``, ``/path``, ``?query``, ``#part`` and relative paths take what they lack from the page; ``.`` and ``..`` are
    resolved, never above the root.  Null for a null page or reference.
    """
    ref = F.trim(reference)
    scheme, host = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)", 1)
    page_path = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    page_query = F.regexp_extract(base, r"(\?[^#]*)", 1)
    path, rest = F.regexp_extract(ref, "^([^?#]*)", 1), F.regexp_extract(ref, "^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(page_path, "^(.*/)", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    steps = F.split(F.substring(whole, 2, 1 << 30), "/")
    last = F.element_at(steps, -1)
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda seen, x: F.when(x == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).when(x == ".", seen).otherwise(F.array_append(seen, x)),
    )
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(path == "", F.concat(scheme, host, page_path, F.when(ref.startswith("?"), F.lit("")).otherwise(page_query), rest))
        .otherwise(F.concat(scheme, host, clean, rest))
    )


def url_template(base: Column, reference: Column) -> Column:
    """Address of a case page: the reference, URL-encoded, as the last query value."""
    return F.concat(base, F.lit("?ref="), F.url_encode(reference))


def path_tail(col: Column, marker: str) -> Column:
    """What follows the last ``marker`` of a path; the whole path without one."""
    return F.substring_index(col, marker, -1)


def top_folders(col: Column, n: int = 2) -> Column:
    return F.substring_index(F.ltrim(col, F.lit("/")), "/", n)


def extension(col: Column) -> Column:
    found = F.lower(F.regexp_extract(col, r"\.([A-Za-z0-9]{1,8})$", 1))
    return F.when(found != "", found)


def merge_terms(a: Column, b: Column, sep: str = "|") -> Column:
    """Terms of two delimited lists, each once, first seen first."""
    both = F.concat(F.split(F.coalesce(a, F.lit("")), f"\\{sep}"), F.split(F.coalesce(b, F.lit("")), f"\\{sep}"))
    return F.array_join(F.array_distinct(F.filter(F.transform(both, F.trim), lambda x: x != "")), sep)


def box_region(lat: Column, lon: Column, boxes: Sequence[tuple[str, float, float, float, float]], default: str = "Unknown") -> Column:
    """First box (name, south, west, north, east) that holds the point."""
    out = None
    for name, s, w, n, e in boxes:
        inside = lat.between(s, n) & lon.between(w, e)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(default)


def size_class(col: Column, small: int, large: int) -> Column:
    return F.when(col < small, "small").when(col < large, "medium").when(col.isNotNull(), "large")


def pct(part: Column, whole: Column, places: int = 1) -> Column:
    """Percentage, null over a zero or null denominator."""
    return F.round(F.try_divide(part * 100, whole), places)


def json_text(col: Column, name: str) -> Column:
    """String field of a JSON object, trimmed; parse errors, values that are no strings and blanks give null."""
    field = F.try_variant_get(F.try_parse_json(col), f"$.{name}", "variant")
    value = F.when(F.schema_of_variant(field) == "STRING", F.trim(F.try_variant_get(field, "$", "string")))
    return F.when(value != "", value)


def usable_hint(candidates: Sequence[tuple[Column, str]]) -> Column:
    """(url, method) of the first candidate that is a URL and not generic; null where none is."""
    out = None
    for url, method in candidates:
        ok = F.coalesce(url.rlike(r"^https?://") & ~is_generic_url(url), F.lit(False))
        pair = F.struct(url.alias("url"), F.lit(method).alias("method"))
        out = F.when(ok, pair) if out is None else out.when(ok, pair)
    return out


def normalise_quotes(col: Column) -> Column:
    """Lower case, plain quotes and dashes, squeezed."""
    return squeeze(F.lower(F.translate(col, "‘’“”–—−\u00a0", "''\"\"--- ")))


#: Characters that do not count at the ends of a quote's segment.
EDGE_PUNCTUATION = " \"'.,;:!?()[]-"


def quote_segments(quote: Column, least: int = 6) -> Column:
    """Parts of a quote between ellipses, normalised, without punctuation at their ends, of ``least`` or more characters."""
    parts = F.split(quote, r"\[?(?:…|\.\s*\.\s*\.)\]?")
    trimmed = F.transform(parts, lambda x: F.trim(normalise_quotes(x), F.lit(EDGE_PUNCTUATION)))
    return F.filter(trimmed, lambda x: F.length(x) >= least)


def segment_overlap(segment: Column, source: Column, shingle: int = 5) -> Column:
    """Share of a segment's word shingles that ``source`` contains; a segment of fewer words counts as a whole."""
    words = F.split(segment, " ")
    n = F.greatest(F.size(words) - shingle + 1, F.lit(1))
    shingles = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, shingle), " "))
    return F.size(F.filter(shingles, lambda x: source.contains(x))) / n


def grounding(quote: Column, source: Column, least: int = 6, shingle: int = 5, share: float = 0.5) -> Column:
    """ok, near_verbatim or missing: is a quote in its source?

    ``ok``: every segment (:func:`quote_segments`) is contained, or there is none.  ``near_verbatim``: at least ``share`` of the
    word shingles of each.  Null or empty quote: null.
    """
    parts = F.struct(normalise_quotes(F.coalesce(source, F.lit(""))).alias("source"), quote_segments(quote, least).alias("segments"))

    def status(x: Column) -> Column:
        whole = F.forall(x["segments"], lambda g: x["source"].contains(g))
        near = F.forall(x["segments"], lambda g: segment_overlap(g, x["source"], shingle) >= share)
        return F.when(whole, "ok").when(near, "near_verbatim").otherwise("missing")

    # over an array of one, so that the source is normalised once and not again for every shingle
    found = F.get(F.transform(F.array(parts), status), F.lit(0))
    return F.when(quote.isNotNull() & (quote != ""), found)


#: Families of documents that always get a second extraction, and the least gain and ratio that let it replace a short one.
FORCED_FAMILIES = ("noise", "spec_calc")
LEAST_GAIN, LEAST_RATIO = 500, 1.5


def fallback_reason(primary: Column, family: Column, least_per_page: float = 40.0, forced: Sequence[str] = FORCED_FAMILIES) -> Column:
    """Why a first extraction, a struct (char_count, page_count, quality, error), asks for a second one; null where it does not.

    The document's family is one that always gets one; it failed; it looks like images only; or it has few characters a page.
    """
    per_page = F.try_divide(F.coalesce(primary["char_count"], F.lit(0)), F.greatest(primary["page_count"], F.lit(1)))
    return (
        F.when(F.trim(family).isin(*forced), "family_override")
        .when(primary["error"].isNotNull(), "primary_error")
        .when(primary["quality"] == "image_only", "image_only")
        .when((primary["page_count"] > 0) & (per_page < least_per_page), "few_chars")
    )


def accept_fallback(primary: Column, fallback: Column, reason: Column, least_gain: int = LEAST_GAIN, least_ratio: float = LEAST_RATIO) -> Column:
    """Whether the second extraction, asked for by ``reason``, replaces the first.

    Never if it failed or has no text, or if nobody asked.  Always for a family that is overridden, a first one that failed or is images
    only, and a rise to ``good``.  For few characters a page it must gain ``least_gain`` characters or reach ``least_ratio`` times as many; else it must be longer.
    """
    had, got = F.coalesce(primary["char_count"], F.lit(0)), F.coalesce(fallback["char_count"], F.lit(0))
    at_once = (reason == "family_override") | primary["error"].isNotNull() | (primary["quality"] == "image_only")
    better = (fallback["quality"] == "good") & (F.coalesce(primary["quality"], F.lit("")) != "good")
    enough = F.when(reason == "few_chars", (got - had >= least_gain) | (got >= had * least_ratio)).otherwise(got > had)
    usable = fallback["error"].isNull() & (got > 0)
    return F.coalesce(reason.isNotNull() & usable & (F.coalesce(at_once, F.lit(False)) | F.coalesce(better, F.lit(False)) | enough), F.lit(False))
