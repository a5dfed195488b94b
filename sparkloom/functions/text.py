"""Text functions as Columns: tokens, truncation, slugs, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def truncate_words(text: Column, limit: int, mark: str = " [...]") -> Column:
    """The first ``limit`` words and a mark; a text within the limit is only trimmed."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    words = F.split(trimmed, r"\s+")
    return F.when(F.size(words) <= limit, trimmed).otherwise(F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit(mark)))


def collapse(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_sentence(text: Column, limit: int = 40) -> Column:
    """Up to the first full stop, else question mark, else exclamation mark that a space follows; ``limit`` words and a mark."""
    flat = collapse(text)
    # fixed values
    stops = (". ", "? ", "! ")
    at = F.coalesce(*[F.when(F.instr(flat, F.lit(stop)) > 1, F.instr(flat, F.lit(stop))) for stop in stops])
    return truncate_words(F.when(at.isNull(), flat).otherwise(F.substring(flat, F.lit(1), at)), limit)


def gist(index: Column, heading: Column, body: Column) -> Column:
    """One line for a slide: its number from 1, its heading and the first sentence of its body."""
    number = F.concat(F.lit("Slide "), (index + 1).cast("string"))
    head, first = collapse(F.coalesce(heading, F.lit(""))), first_sentence(F.coalesce(body, F.lit("")))
    label = F.concat(F.lit("- "), number, F.lit(": "), F.when(head != "", head).otherwise(number))
    return F.when(first != "", F.concat(label, F.lit(": "), first)).otherwise(label)


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; empty if there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def first_words(text: Column, n: int = 6) -> Column:
    return F.array_join(F.slice(F.split(collapse(F.coalesce(text, F.lit(""))), " "), 1, n), " ")


def long_terms(text: Column, n: int = 8) -> Column:
    """The ``n`` longest distinct words of a letter and at least three letters, digits, signs of connection; ties in order."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z][\p{L}\p{N}_-]{3,})"), F.lit(1)), F.lower))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda r: r["w"]), 1, n)


def diagram_label(term: Column, limit: int = 28) -> Column:
    """A term without signs that a diagram's syntax knows; "term" if nothing is left."""
    plain = F.left(F.regexp_replace(F.regexp_replace(term, r"[^\p{L}\p{N}_ -]", ""), r"^\s+|\s+$", ""), F.lit(limit))
    return F.when(F.coalesce(plain, F.lit("")) == "", "term").otherwise(plain)


def display_title(path: Column) -> Column:
    """The file's name without folders and suffix, with spaces for underscores and hyphens."""
    name = F.regexp_extract(F.regexp_replace(path, r"\\", "/"), "([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")
    plain = F.trim(F.regexp_replace(stem, "[_-]+", " "))
    return F.when(F.coalesce(plain, F.lit("")) == "", "Untitled deck").otherwise(plain)


def source_path(path: Column) -> Column:
    """Folders and name without empty, "." and ".." parts; "upload" if nothing is left."""
    parts = F.transform(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: F.trim(x))
    kept = F.array_join(F.filter(parts, lambda x: ~x.isin("", ".", "..")), "/")
    return F.when(F.coalesce(kept, F.lit("")) == "", "upload").otherwise(kept)


def legal_id(value: Column) -> Column:
    """Whether a text may name a folder: letters, digits, points, hyphens, underscores, a letter or digit first, no two points in a row."""
    return F.coalesce(value.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z") & ~F.contains(value, F.lit("..")), F.lit(False))


def safe_filename(name: Column) -> Column:
    """A name of up to 80 legal characters with a suffix of up to 12; "file" for what is missing."""
    base = F.ltrim(F.regexp_extract(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), "([^/]*)$", 1))
    base = F.regexp_replace(F.trim(base), r"^\.+", "")
    base = F.when(base == "", "file").otherwise(base)
    legal = lambda c, to: F.regexp_replace(c, r"[^A-Za-z0-9._-]+", to)
    dotted = F.contains(base, F.lit("."))
    stem = F.when(dotted, F.regexp_extract(base, r"^(.*)\.[^.]*$", 1)).otherwise(base)
    suffix = F.when(dotted, F.left(legal(F.regexp_extract(base, r"\.([^.]*)$", 1), ""), F.lit(12))).otherwise("")
    stem = F.regexp_replace(legal(stem, "_"), "^_+|_+$", "")
    stem = F.left(F.when(stem == "", "file").otherwise(stem), F.lit(80))
    return F.when(suffix != "", F.concat(stem, F.lit("."), suffix)).otherwise(stem)


def folder_name(name: Column, limit: int = 80) -> Column:
    """A folder's name: white space collapsed, no slashes and control signs, no points at the ends."""
    plain = F.trim(collapse(F.coalesce(name, F.lit(""))), F.lit(" ."))
    return F.trim(F.left(collapse(F.regexp_replace(plain, r"[\\/\x00-\x1f]", " ")), F.lit(limit)))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash over the UTF-16 units of a text without signs beyond the basic plane."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    # fixed values of the hash
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * 0x01000193, F.lit(1 << 32)))


def json_value(value: Column, kind: str) -> Column:
    """A value as it may stand in JSON: dates in ISO form, numbers that are not finite as text."""
    if kind in ("float", "double"):
        odd = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
        return F.coalesce(odd, value.cast("string"))
    if kind == "date":
        return F.date_format(value, "yyyy-MM-dd")
    if kind.startswith("timestamp"):
        return F.regexp_replace(F.date_format(value.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    return value.cast("string")


def sane_diagram(source: Column) -> Column:
    """Whether a text looks like a diagram: its fence taken off, a known head, and no styling or click lines."""
    fenced = F.regexp_extract(F.trim(source), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", 1)
    text = F.lower(F.regexp_replace(F.when(fenced != "", fenced).otherwise(source), r"^\s+|\s+$", ""))
    # fixed values
    heads = ("graph ", "flowchart ", "sequencediagram", "classdiagram", "statediagram", "erdiagram", "mindmap", "journey", "gantt", "pie")
    # fixed values
    banned = ("classdef", "style ", "click ")
    known = F.lit(False)
    for head in heads:
        known = known | F.regexp_extract(text, "^([^\\r\\n]*)", 1).startswith(head)
    for word in banned:
        known = known & ~F.contains(text, F.lit(word))
    return F.coalesce(known, F.lit(False))


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "course").otherwise(out)


def normalise(text: Column) -> Column:
    """Line ends as newlines, no-break spaces as spaces, no zero-width spaces and control signs, no blanks before newlines, at most one empty line."""
    for pattern, to in (("\r\n?", "\n"), ("\u00a0", " "), ("\u200b", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"[ \t]+(?=\n|\z)", ""), ("\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# fixed value
REDACTED = "sk-***REDACTED***"


def scrub(text: Column) -> Column:
    """Texts without what looks like an access key, or stands in an Authorization header."""
    keys = F.regexp_replace(text, "sk-[A-Za-z0-9]{8,}", REDACTED.replace("$", r"\$"))
    return F.regexp_replace(keys, r"(?i)(authorization\s*[:=]\s*)(bearer\s+)?\S+", f"$1{REDACTED}")


# fixed values: marks of a release at the end of a name, and words that stay small inside a title
RELEASES = ("v", "ver", "version", "rev", "revision", "final", "draft", "copy", "edit", "updated", "latest", "new", "fixed", "done", "export")
SMALL = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "into", "nor", "of", "on", "or", "the", "to", "vs", "with")


def deck_label(title: Column) -> Column:
    """A file's name as a title: without its ending and the release marks at its end, words in title case unless they have a case of their own or are small; null for null."""
    plain = F.regexp_replace(F.regexp_replace(title, r"^\s+|\s+$", ""), r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
    words = F.array_join(F.filter(F.split(plain, r"[\s_-]+"), lambda w: w != ""), " ")
    # never the first word: a name doesn't become empty
    kept = F.regexp_replace(words, rf"(?i)(?: (?:{'|'.join(RELEASES)})[0-9]*)+$", "")

    def shown(word: Column, i: Column) -> Column:
        own = ~word.rlike("[A-Za-z]") | (word.rlike("[a-z]") & word.rlike("[A-Z]"))
        titled = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))
        return F.when(own, word).when((i > 0) & F.lower(word).isin(*SMALL), F.lower(word)).otherwise(titled)

    return F.array_join(F.transform(F.split(kept, " "), shown), " ")
