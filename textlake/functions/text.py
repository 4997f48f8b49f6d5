"""Column functions on strings, hashes and vectors. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Str = Column | str


def _c(x: Str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Str) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def clean_header(x: Str) -> Column:
    """A heading without its leading words and numbers, punctuation or capitals."""
    out = F.trim(F.lower(_c(x)))
    for lead in ("section ", "part ", "chapter ", "§ "):
        out = F.regexp_replace(out, "^" + lead, "")
    out = F.regexp_replace(out, r"^[\d.]+\s*", "")
    return squeeze(F.regexp_replace(out, r"[^\p{L}\p{N}_\s-]", ""))


def header_key(x: Str) -> Column:
    """A heading as an identifier with underscores."""
    return F.regexp_replace(clean_header(x), r"[\s-]+", "_")


def header_title(x: Str) -> Column:
    """A heading with a capital after anything that is no letter."""
    marked = F.regexp_replace(clean_header(x), r"([^\p{L}]|^)(\p{L})", "$1\u0001$2")
    parts = F.split(marked, "\u0001")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), ""))


def header_words(x: Str) -> Column:
    """A heading as plain small ASCII words, & spelled out."""
    return squeeze(F.regexp_replace(F.replace(F.lower(_c(x)), F.lit("&"), F.lit("and")), "[^a-z ]", ""))


def all_capitals(x: Str) -> Column:
    """Whether a text longer than two characters has cased letters, all of them capitals."""
    return _c(x).rlike(r"\p{Lu}") & ~_c(x).rlike(r"\p{Ll}") & (F.length(_c(x)) > 2)


def title_case(x: Str) -> Column:
    """Whether every word begins with a capital and has no other."""
    return _c(x).rlike(r"\p{Lu}") & ~_c(x).rlike(r"(^|[^\p{L}])\p{Ll}") & ~_c(x).rlike(r"\p{L}\p{Lu}")


def plain_query(x: Str) -> Column:
    """A question in small letters, without marks at its end, short forms of "is" spelled out."""
    out = squeeze(F.regexp_replace(F.trim(F.lower(_c(x))), r"[?.!,;:]+$", ""))
    out = F.replace(F.replace(out, F.lit("what's"), F.lit("what is")), F.lit("whats"), F.lit("what is"))
    return F.replace(out, F.lit("'s"), F.lit(" is"))


def trigrams(x: Str) -> Column:
    """Distinct runs of three characters of each word, taken with two blanks before and one after it."""
    words = F.filter(F.split(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Str, b: Str) -> Column:
    """Shared trigrams as a share of all; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def id31(x: Str) -> Column:
    """A stable id of 31 bits from a string."""
    return F.conv(F.substring(F.sha2(_c(x), 256), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(2147483647))


def short_hash(x: Str) -> Column:
    """The first eight hexadecimal digits of the SHA-256 hash."""
    return F.substring(F.sha2(_c(x), 256), 1, 8)


def token_estimate(x: Str) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(x)) / 4)).cast("bigint")


def keywords(x: Str, stop: list[str]) -> Column:
    """Distinct words of more than two characters that are no stop words, in order, without marks around them."""
    words = F.filter(F.split(F.lower(_c(x)), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(stop))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[?.!,;:]+|[?.!,;:]+$", "")), lambda w: w != ""))


def preview(x: Str, n: int = 200) -> Column:
    """The first `n` characters and an ellipsis."""
    return F.concat(F.substring(_c(x), 1, n), F.lit("..."))


def basename(x: Str) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(_c(x), "/"), -1)


def dot(a: Column, b: Column) -> Column:
    """Inner product, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null if a vector is 0."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def is_junk(x: Str) -> Column:
    """Lines of a table of contents and bare numbers: short texts with leader dots, or of digits, blanks and dots."""
    t = F.trim(_c(x))
    return (F.length(t) < 50) & (t.rlike(r"\.{3,}\s*\d+") | t.rlike(r"^[\d\s.]+$"))


def search_terms(x: Str) -> Column:
    """A text without anything but letters, digits, hyphens and single blanks."""
    return squeeze(F.regexp_replace(_c(x), r"[^\p{L}\p{N}_\s-]", ""))


def reply_line(x: Str, label: str) -> Column:
    """What follows a label at a line's start, in small letters; null if there is nothing, or unknown."""
    found = F.lower(F.trim(F.regexp_extract(_c(x), rf"(?:^|\n){label}:[ \t]*([^\n]*)", 1)))
    return F.when((found != "") & (found != "unknown"), found)


def document_name(x: Str) -> Column:
    """The generic name that a reply gives, else the brand, else a name in the wording of a title."""
    title = F.lower(F.regexp_extract(_c(x), r"(?i)(?:product\s+monograph|prescribing\s+information)[\s-]*([a-z]+)", 1))
    form = F.lower(F.regexp_extract(_c(x), r"(?:^|\n)([A-Z][A-Za-z]{3,})\s[^\n]*(?:tablet|capsule|injection)", 1))
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(reply_line(x, "GENERIC"), reply_line(x, "BRAND"), filled(title), filled(form), F.lit("unknown_drug"))


# Kinds of files by their suffix.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "pdf": "application/pdf"}


def mime_type(path: Str) -> Column:
    """The kind of a file by its suffix."""
    suffix = F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*(F.when(suffix == k, F.lit(v)) for k, v in MIME.items()), F.lit("application/octet-stream"))
