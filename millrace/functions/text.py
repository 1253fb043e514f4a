"""Text functions of ingestion, retrieval and chat as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of web scripts: ASCII white space and the Unicode blanks that Java's \s leaves out.
BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same signs one by one, for trimming without a pattern.
BLANK_SIGNS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Fixed values of the rewrite gate.
QUESTION_OPENERS = ("how", "what", "why", "when", "where")
COMMANDS = ("vite", "npm", "pnpm", "yarn", "bun", "npx", "node")
ACTIONS = ("build", "preview", "dev", "serve", "start", "run", "test", "install", "create", "add", "remove")
CONTEXT_OPENERS = ("what about", "how does that", "how does it")
MAX_QUERY_WORDS = 30


def normalize_whitespace(text: Column) -> Column:
    """Each run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def normalize_multiline(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    lines = F.transform(F.split(text, "\n"), normalize_whitespace_ends)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize_whitespace_ends(text: Column) -> Column:
    """Without white space at either end; only the ends are looked at, whatever the length."""
    return F.btrim(text, F.lit(BLANK_SIGNS))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed one time for each row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kept_if(value: Column, test: Callable[[Column], Column]) -> Column:
    """``value``, computed one time for each row, or null where it fails the test."""
    return F.get(F.filter(F.array(value), test), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def estimate_tokens(text: Column, utf16: bool = False) -> Column:
    """A quarter of the signs, rounded up; ``utf16`` counts signs beyond the basic plane twice, as web scripts do."""
    signs = (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long") if utf16 else F.length(text)
    return F.ceil(signs / 4)


def anchor_url(url: Column, anchor: Column) -> Column:
    return F.when(anchor.isNotNull() & (anchor != ""), F.concat(url, F.lit("#"), anchor)).otherwise(url)


def url_path_segments(url: Column) -> Column:
    """Non-empty parts of the address's path; null for what is no address."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    valid = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")
    return F.when(valid, F.filter(F.split(path, "/"), lambda s: s != ""))


def language_and_product(url: Column) -> tuple[Column, Column]:
    """Second and third path parts, with the defaults of documentation sites."""
    parts = url_path_segments(url)
    return F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("en-us")), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("general"))


def is_natural_question(query: Column) -> Column:
    return F.lower(query).rlike("^(?:" + "|".join(QUESTION_OPENERS) + ") ")


def is_quoted(query: Column) -> Column:
    """Starts with a quote that comes again after at least one sign."""
    return query.rlike("(?s)^(?:\"[^\"].*\"|'[^'].*'|`[^`].*`)")


def is_command_like(query: Column) -> Column:
    parts = words(query)
    plain = ~F.exists(parts, lambda t: ~t.rlike("^[A-Za-z0-9._:/=-]+$"))
    known = F.lower(parts[0]).isin(*COMMANDS) | F.exists(parts, lambda t: F.lower(t).isin(*ACTIONS))
    return ~is_natural_question(query) & ~query.contains("?") & F.size(parts).between(2, 5) & plain & known


def is_identifier_like(query: Column) -> Column:
    marked = query.rlike(r"[_./():{}\-]") | query.rlike("[a-z][A-Z]")
    return ~is_natural_question(query) & (marked | is_command_like(query))


def is_context_dependent(query: Column) -> Column:
    return query.rlike(r"(?i)^(?:" + "|".join(CONTEXT_OPENERS) + r")\b")


def rewrite_gate(query: Column, enabled: bool = True) -> Column:
    """The reason why a query may (``eligible``) or may not be rewritten; the first that holds in this order."""
    q = normalize_whitespace(query)
    n = word_count(q)
    if not enabled:
        return F.lit("disabled")
    return (
        F.when(is_quoted(q), "quoted_query")
        .when((n < 2) & ~is_identifier_like(q), "query_too_short")
        .when(n > MAX_QUERY_WORDS, "query_too_long")
        .when(is_identifier_like(q), "identifier_like")
        .when(is_context_dependent(q), "context_dependent")
        .otherwise("eligible")
    )


def equivalent_queries(a: Column, b: Column) -> Column:
    return F.lower(normalize_whitespace(a)) == F.lower(normalize_whitespace(b))


def cited_indexes(text: Column) -> Column:
    """Distinct positive numbers in bracketed lists such as [1, 2], ascending."""
    lists = F.regexp_extract_all(text, F.lit(r"\[([0-9,\s]+)\]"), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.regexp_extract(x, r"^\s*([0-9]+)", 1))
    whole = F.transform(F.filter(numbers, lambda x: x != ""), lambda x: x.cast("decimal(38,0)").cast("long"))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda x: x > 0)))


def strip_references(text: Column) -> Column:
    bold = F.regexp_replace(text, r"(?is)\n+\*\*references:\*\*.*$", "")
    return normalize_whitespace_ends(F.regexp_replace(bold, r"(?is)\n+references:\s*.*$", ""))


def is_fallback(text: Column, phrase: str = "i don't know based on the indexed") -> Column:
    return F.lower(text).contains(phrase)


def cut_with_dots(text: Column, limit: int) -> Column:
    """The first ``limit`` signs without white space at the end, and three dots, if the text is longer."""
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.substring(text, 1, limit), BLANK + "+$", ""), F.lit("..."))).otherwise(text)


def mask_email(address: Column) -> Column:
    name, domain = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
    whole = address.rlike("^[^@]+@[^@]+$")
    return F.when(whole & (F.length(name) > 2), F.concat(F.substring(name, 1, 2), F.lit("***@"), domain)).when(whole, F.concat(F.lit("**@"), domain)).otherwise("redacted")


def code_language(classes: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(classes, r"(?i)lang(?:uage)?-([a-z0-9_+\-]+)", 1)), F.lit(""))


def json_body(reply: Column) -> Column:
    """The JSON text of a model's reply: the fenced block, or the first brace to the last."""
    fenced = F.regexp_extract(reply, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(braces), F.lit(""))


def clean_strings(values: Column) -> Column:
    """Trimmed, non-empty, first occurrence of each; null if none is left."""
    kept = F.array_distinct(F.filter(F.transform(values, normalize_whitespace_ends), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(kept) > 0, kept)


def retry_seconds(delay: Column) -> Column:
    return F.nullif(F.regexp_extract(delay, r"^([0-9]+)(?:\.[0-9]+)?s$", 1), F.lit("")).cast("long")


def is_uuid(value: Column) -> Column:
    return value.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case alphanumeric words, each padded by two blanks before and one after."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    padded = F.transform(found, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of two trigram arrays."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def split_sentences(text: Column, limit: int) -> Column:
    """Parts at the first boundary (blank line, line, sentence) at which there are several and all fit; else cut every ``limit`` signs."""

    def parts_of(body: Column) -> Column:
        def at(boundary: str) -> Column:
            parts = F.filter(F.transform(F.split(body, boundary), normalize_whitespace_ends), lambda x: x != "")
            return kept_if(parts, lambda p: (F.size(p) > 1) & ~F.exists(p, lambda x: F.length(x) > limit))

        pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1)), F.lit(limit)), lambda i: normalize_whitespace_ends(F.substring(body, i, F.lit(limit))))
        several = F.coalesce(at(r"\n\s*\n"), at(r"\n"), at(r"(?<=[.!?])\s+"), F.filter(pieces, lambda x: x != ""))
        return F.when(body == "", F.array().cast("array<string>")).when(F.length(body) <= limit, F.array(body)).otherwise(several)

    return once(normalize_whitespace_ends(text), parts_of)


def hard_cut(text: Column, limit: int) -> Column:
    """Pieces of ``limit`` signs; none for the empty text."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(limit)), lambda i: F.substring(text, i, F.lit(limit)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(pieces)
