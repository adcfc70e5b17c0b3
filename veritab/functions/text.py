"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an address, a phone number, and a long run of digits.
EMAIL = r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d ().-]{7,}\d"
DIGITS = r"\d{9,}"

# Personal data by a column's name, and by whole values.
NAME_RULES = [
    ("email address", r"e_?mail"),
    ("phone number", r"phone|mobile|(^|_)cell(_|$)|(^|_)tel(ephone)?(_|$)|(^|_)fax"),
    (
        "person name",
        r"^(first|last|full|given|family|middle|maiden|sur|user|respondent|patient|"
        r"participant|student|customer|person|contact|employee|client)_?name$|surname",
    ),
    ("address", r"address|street|postcode|postal|zip_?code|(^|_)zip$"),
    ("birth date", r"birth|(^|_)dob(_|$)|birthday"),
    ("government ID", r"ssn|social_security|passport|national_id|(^|_)nin(_|$)|tax_id|driver_?lic"),
    ("IP address", r"(^|_)ip(_?addr(ess)?)?$"),
]
VALUE_RULES = [
    ("email address", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"),
    ("phone number", r"^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}$"),
    ("IP address", r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"),
]
VALUE_SHARE, BARE_NAME_UNIQUENESS = 0.5, 0.5

# Words that tell nothing, and more that questions are full of.
STOP_WORDS = [
    "the", "of", "in", "on", "at", "to", "for", "by", "with", "and", "or", "a", "an", "is", "are",
    "was", "were", "be", "been", "what", "which", "who", "how", "many", "much", "did", "do",
    "does", "has", "have", "had", "per", "from", "as", "that", "this", "these", "those", "than",
    "its", "their", "there", "it", "any", "all", "each",
]
QUESTION_WORDS = [
    "affect", "affects", "effect", "effects", "influence", "impact", "relationship", "between",
    "whether", "associated", "association", "difference", "differ", "compared", "among",
    "using", "use", "study", "studies", "paper", "data", "can", "more", "less", "higher",
    "lower", "into", "over", "under", "about", "after", "before", "during",
]


def scrub(text: Column) -> Column:
    """Mask e-mail addresses, then phone numbers, then runs of nine digits or more."""
    out = F.regexp_replace(text, EMAIL, "<email>")
    out = F.regexp_replace(out, PHONE, "<phone>")
    return F.regexp_replace(out, DIGITS, "<number>")


def words(text: Column) -> Column:
    """Distinct lower-case words of ASCII letters and digits, two characters or more, no stop words."""
    found = F.filter(F.array_distinct(F.split(F.lower(text), r"[^a-z0-9]+")), lambda w: F.length(w) > 1)
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def stem(word: Column) -> Column:
    """A word without apostrophes at its ends and without its plural ending: studies, grades, but not less, status or basis."""
    word = F.trim(word, F.lit("'"))
    plural = F.endswith(word, F.lit("s")) & ~word.rlike("(ss|us|is)$") & (F.length(word) > 3)
    return F.when((F.length(word) > 4) & word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when(plural, F.regexp_replace(word, "s$", "")).otherwise(word)


# Fixed value: a term's characters; hyphens and apostrophes within it belong to it.
TERM = r"[a-z0-9][a-z0-9'\-]*[a-z0-9']|[a-z0-9]"


def terms(text: Column) -> Column:
    """What a question asks about: distinct stems of words of three characters or more, no numbers, stop or question words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    kept = F.filter(F.array_except(found, F.array(*map(F.lit, STOP_WORDS + QUESTION_WORDS))), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))
    return F.array_distinct(F.transform(kept, stem))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one is all zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
