"""Text rules as Column expressions: markup, normalization, query terms, occurrence counts.

Patterns carry (?U), so digits, blanks and word edges are Unicode's, and (?d), so only a line feed ends
a line. U+001C to U+001F count as blanks, too.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANK = r"[\s\x1c-\x1f]"

# The markup of tagged texts.
HEADER_END = "#META#Header#End#"
PAGE = r"(?U)(?:Page|Folio)V(\d+)P(\d+)([AB])?"
MILESTONE = r"(?U)\bMilestone\d+\b"
LEGACY_MILESTONE = r"(?iU)\b(?:ms|Milestone)\d+\b"
LINE_PREFIX = rf"(?mdU)^(?:###{BLANK}+\|(?:EDITOR|PARATEXT|APPENDIX)\|{BLANK}*|###{BLANK}+\|+{BLANK}*|#{BLANK}+|~~)"
DOLLAR_PREFIX = rf"(?mdU)^###{BLANK}+\$+{BLANK}*"

# Letters of search text.
DIACRITICS = "[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed]"
ALEFS, ALEF = "ٱأإآ", "ا"
YEH_IN, YEH = "ى", "ي"
TATWEEL = "ـ"
#: The range that holds all of these.
LETTERS = "[\u0610-\u06ed]"
WORD = "[\u0621-\u063a\u0641-\u064a\u0660-\u0669A-Za-z0-9]+"
PROCLITICS = ("و", "ف", "ب", "ك")
ARTICLE, DOUBLE_LAM = "ال", "لل"

# Stop words in normalized spelling.
STOP_WORDS = ("في", "من", "علي", "الي", "عن", "هل", "ما", "ماذا", "كيف", "متي", "مع", "او", "و", "ثم", "ان", "اذا", "هذا", "هذه", "ذلك", "تلك", "هو", "هي")


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility composition, the one rule Spark has no function for. Of a batch only one text at a time is a Python string."""
    return pa.array((None if not x.is_valid else unicodedata.normalize("NFKC", x.as_py()) for x in texts), pa.string(), size=len(texts))


def trimmed(text: str) -> str:
    """``strip`` for a string on the driver."""
    return text.strip()


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){BLANK}+", " "))


def _where(text: Column, held: Callable[[Column], Column], rule: Callable[[Column], Column]) -> Column:
    """``rule`` of texts for which ``held`` is true, others as they are. The text is bound, so it stands once in the plan's code."""
    return F.get(F.transform(F.array(text), lambda x: F.when(held(x), rule(x)).otherwise(x)), 0)


def strip_markup(text: Column) -> Column:
    def rule(x: Column) -> Column:
        for pattern, to in ((PAGE, " "), (MILESTONE, " "), (LINE_PREFIX, ""), (DOLLAR_PREFIX, "")):
            x = F.regexp_replace(x, pattern, to)
        return x

    # Every mark holds one of these, and taking one out makes no new one; a search for them costs far less than four patterns.
    return _where(text, lambda x: reduce(or_, [F.contains(x, F.lit(sign)) for sign in ("PageV", "FolioV", "Milestone", "#", "~~")]), rule)


def normalize(text: Column, composed: bool = False) -> Column:
    """Search text. ``composed``: the text is known to be in NFKC, so the plan stays inside the JVM."""
    text = strip_markup(text)
    if not composed:
        text = nfkc(text)
    return squeeze(_where(text, lambda x: x.rlike(LETTERS), lambda x: F.translate(F.regexp_replace(x, DIACRITICS, ""), ALEFS + YEH_IN + TATWEEL, ALEF * len(ALEFS) + YEH)))


def normalize_legacy(text: Column, composed: bool = False) -> Column:
    """``normalize``, then without short milestones and isolated pipes."""
    text = F.regexp_replace(normalize(text, composed), LEGACY_MILESTONE, " ")
    return squeeze(F.regexp_replace(text, r"(?U)(?<![^\s\x1c-\x1f])\|(?![^\s\x1c-\x1f])", " "))


def tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(WORD), F.lit(0))


def detach(term: Column) -> Column:
    """A term without a proclitic that stands before the definite article."""
    long = F.length(term) >= 5
    return (
        F.when(long & F.substring(term, 1, 1).isin(*PROCLITICS) & (F.substring(term, 2, 2) == ARTICLE), F.substr(term, F.lit(2)))
        .when(long & F.startswith(term, F.lit(DOUBLE_LAM)), F.concat(F.lit(ARTICLE), F.substr(term, F.lit(3))))
        .otherwise(term)
    )


def query_terms(normalized: Column) -> Column:
    """Distinct terms of a query by first occurrence, whatever their case, without stop words unless
    nothing else is left."""
    found = F.transform(tokens(normalized), detach)
    first = F.filter(found, lambda t, i: F.array_position(F.transform(found, F.lower), F.lower(t)) == i + 1)
    telling = F.filter(first, lambda t: ~t.isin(*STOP_WORDS))
    return F.when(F.size(telling) > 0, telling).otherwise(first)


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text`` without overlap; 0 for an empty part."""
    # Lengths in bytes are known without a look at the text.
    return F.when(F.octet_length(part) == 0, F.lit(0)).otherwise(((F.octet_length(text) - F.octet_length(F.replace(text, part, F.lit("")))) / F.octet_length(part)).cast("int"))


def half_even(value: Column, digits: int = 3) -> Column:
    """A double to some decimal digits, ties to the even one, where a tie is one of the binary value itself.

    The value is taken apart into whole numbers exactly, as ``n / 2**66``, and rounded as such (magnitudes up to
    2**30; others are left to the built-in function)."""
    scale, unit = 10**digits, F.lit(str(1 << 66)).cast("decimal(38,0)")
    high = F.floor(F.abs(value) * float(1 << 13))
    low = F.floor((F.abs(value) * float(1 << 13) - high) * float(1 << 53))
    whole = lambda c: c.cast("decimal(20,0)")
    n = (whole(high) * F.lit(1 << 53).cast("decimal(17,0)") + whole(low)).cast("decimal(33,0)")
    scaled = (n * F.lit(scale).cast("decimal(5,0)")).cast("decimal(38,0)")
    down = F.floor(scaled / unit).cast("long")
    rest = (scaled - (down.cast("decimal(18,0)") * F.lit(str(1 << 66)).cast("decimal(20,0)")).cast("decimal(38,0)")) * 2
    exact = down + F.when((rest > unit) | ((rest == unit) & (down % 2 == 1)), 1).otherwise(0)
    rounded = F.when(value < 0, -exact).otherwise(exact) / float(scale)
    return F.when(F.abs(value) < float(1 << 30), rounded).otherwise(F.bround(value, digits))
