"""Speed units in texts, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit codes and the words that name them, in the order of testing. A text is lower case, its digits ASCII.
UNIT_WORDS = [
    ("dkmh", r"tenths?\s+(of\s+)?(a\s+)?k|1/10\s*k|x\s*0[.,]1\s*k|(ten times|tenfold|10\s*x|zehnfach)[^.;]*k"),
    ("mph", r"m\.?p\.?h|\bmi\s*/\s*h|\bmiles?\b|meilen|\bmilles?\b|\bmillas?\b|миль"),
    ("kn", r"\bknots?\b|knoten|(?<![a-z])kts?\b|(?<![a-z])kn\b|n(œ|oe)uds|nudos|узл"),
    ("fps", r"(?<![a-z])ft\s*/\s*s|(?<![a-z])fps\b|\b(feet|foot)\b"),
    ("kmh", r"km\s*/\s*h|kmh|kph|k\.p\.h|kilom|км\s*/\s*ч|(?<![a-z])km\b"),
    ("mps", r"(?<![a-z])m\s*/\s*s|(?<![a-z])m\s+s-1|\bmet(re|er)s?\b|\bmètres?\b|\bmetros?\b|(?<!к)м\s*/\s*с|\bmps\b"),
]
WIDE = "０１２３４５６７８９．，；／"
ASCII = "0123456789.,;/"


def plain(text: Column) -> Column:
    """Lower case, full-width digits and points made ASCII, all kinds of spaces one space."""
    return F.regexp_replace(F.lower(F.translate(text, WIDE, ASCII)), r"[\s  -​ 　]+", " ")


def first_number(plain_text: Column) -> Column:
    """The first decimal number, with comma or point; null if there is none."""
    found = F.nullif(F.regexp_extract(plain_text, r"(\d+(?:[.,]\d+)?)", 1), F.lit(""))
    return F.replace(found, F.lit(","), F.lit(".")).cast("double")


def named_unit(plain_text: Column) -> Column:
    """Code of the first unit of UNIT_WORDS that the text names; null if it names none."""
    tests = F.lit(None).cast("string")
    for code, words in reversed(UNIT_WORDS):
        tests = F.when(F.regexp_like(plain_text, F.lit(words)), F.lit(code)).otherwise(tests)
    return tests


def text_unit(plain_text: Column) -> Column:
    """The unit that belongs to the first number: of its own part up to a semicolon, else of the whole text."""
    own = F.regexp_extract(plain_text, r"^([^;]*\d[^;]*)", 1)
    return F.coalesce(named_unit(own), named_unit(plain_text))
