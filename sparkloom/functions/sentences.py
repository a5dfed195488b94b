"""Sentences and what is left of a text without some of them, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
BANNED = (
    "was derived from", "this overview for", "treat it as a rough", "rough map of the", "in this order:", "the opening slides", "indicate the following", "subject matter",
    "no syllabus or programme document", "no reference documents have been provided", "drawn from the imported material", "the imported material alone", "drop the syllabus in",
    "deck(s) covering roughly", "slide(s) covering roughly", "will be covered",
)
# fixed values
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "no.", "fig.", "p.", "pp.", "al.")

_CLOSERS = "[\"'”’)\\]]"
_NO_STOP = "|".join(a[:-1].replace(".", r"\.") for a in ABBREVIATIONS)
#: A stop ends a sentence unless another one is before it, a digit follows, or an abbreviation ends with it.
_END = rf"((?<!\.)(?:[!?]|(?i:(?<!{_NO_STOP})\.))(?=$|\s|{_CLOSERS}){_CLOSERS}*)"
_MARK = "\x01"
_BLANKS = r"[\s\x{00a0}]"


def pieces(text: Column) -> Column:
    """The text cut after every sentence and newline; joined they are the text again (but for the control sign 1, which goes)."""
    plain = F.regexp_replace(text, _MARK, "")
    return F.split(F.regexp_replace(F.regexp_replace(plain, _END, f"$1{_MARK}"), "\n", f"\n{_MARK}"), _MARK)


def sentences(text: Column) -> Column:
    lines = F.regexp_replace(text, "\r\n?", "\n")
    return F.filter(F.transform(pieces(lines), _stripped), lambda s: s != "")


def _stripped(piece: Column) -> Column:
    return F.regexp_replace(piece, f"^{_BLANKS}+|{_BLANKS}+$", "")


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def without_agenda(text: Column) -> Column:
    return F.regexp_replace(text, r"(?im)^(\s*[-*•]?\s*)Slide\s+\d+\s*:\s*", "$1")


def punctuation(text: Column) -> Column:
    """Dashes as commas; semicolons as full stops, with a capital after them."""
    parts = F.split(F.regexp_replace(text, r"\s*[\x{2013}\x{2014}]\s*", ", "), r";\s+(?=[a-zA-Z])")
    joined = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.concat(F.lit(". "), _capital(p))), ""))
    return F.regexp_replace(joined, ";", ".")


def holds_any(text: Column, phrases: tuple[str, ...] = BANNED) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for p in phrases:
        found = found | low.contains(p.lower())
    return found


def without_sentences(text: Column, phrases: tuple[str, ...] = BANNED) -> Column:
    """``text`` without the sentences that hold a phrase.

    White space between kept sentences stays as it is; where some went, one space is left, and a small letter after a
    full stop becomes a capital. A null text gives an empty one.
    """
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("gap"), F.lit(True).alias("kept"))

    def step(so_far: Column, piece: Column) -> Column:
        core = _stripped(piece)
        lead, trail = F.regexp_extract(piece, f"^({_BLANKS}*)", 1), F.regexp_extract(piece, f"({_BLANKS}*)$", 1)
        out, gap, kept = so_far["out"], so_far["gap"], so_far["kept"]
        spaced = F.when((out == "") | out.rlike(f"{_BLANKS}$"), out).otherwise(F.concat(out, F.lit(" ")))
        opens = spaced.rlike(rf"[.!?]{_CLOSERS}?\s$") & core.rlike("^[a-z]")
        joined = F.when(kept, F.concat(out, gap, lead, core)).otherwise(F.concat(spaced, F.when(opens, _capital(core)).otherwise(core)))
        empty, banned = core == "", holds_any(core, phrases)
        return F.struct(
            F.when(empty | banned, out).otherwise(joined).alias("out"),
            F.when(empty, F.concat(gap, piece)).otherwise(trail).alias("gap"),
            F.when(empty, kept).otherwise(~banned).alias("kept"),
        )

    left = F.aggregate(pieces(text), start, step, lambda s: F.concat(s["out"], F.when(s["kept"], s["gap"]).otherwise("")))
    return punctuation(without_agenda(F.when(holds_any(text, phrases), left).otherwise(text)))


def json_object(text: Column) -> Column:
    """A JSON object held in ``text``: fenced, the text itself, or from its first to its last brace; the first that parses. Null if none does."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = [F.when(F.startswith(F.trim(c), F.lit("{")), F.try_parse_json(c)) for c in (fenced, text, outer)]
    return F.to_json(F.coalesce(*parsed))
