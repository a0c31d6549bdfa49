"""What is derived from a text alone: subject, type, and whether the language suits the vector model.

Null texts give a null subject and type, and count as suitable (they have no letters).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import bounded, let

MOST_CHARS = 300
# Patterns that name a subject, over the text in lower case.
SUBJECTS = {
    "location": "\\b(?:lives?|living|located|resides?|based)\\b",
    "operating-system": "\\boperating system\\b|\\b(?:linux|windows|macos|ubuntu|debian|fedora|arch)\\b",
    "email": "\\bemail\\b|[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}",
    "timezone": "\\btime ?zone\\b|\\butc[+-]?[0-9]",
    "name": "\\b(?:name is|named|call me|goes by)\\b",
    "programming-language": "\\b(?:programs?|coding|codes?|develops?|writes?) in\\b|\\bprogramming language\\b",
    "current-project": "\\b(?:working on|building|developing|current project)\\b",
}
OWNED = "\\b(?:my|your|their|his|her|our|its|the|[a-z]+'s)\\s+([a-z]+(?:\\s+[a-z]+){0,2})\\s+(?:is|are|was|were)\\b"
NOT_KEY = "a an and are as at be by for from has have in is it its of on or that the their this to was were with".split()
IDENTITY = "name is|named|goes by|call me|lives? in|living in|based in|resides?|works? (?:as|at|for)|is an? |pronouns|speaks?|nationality|born in|birthday"
PREFERENCE = "prefers?|preferred|likes?|dislikes?|loves?|hates?|favou?rite|enjoys?|wants?|avoids?|instead of|always|never"
LATIN_SHARE = 0.8


def java(pattern: str) -> str:
    """A pattern whose word boundaries are ASCII on the JVM, too: before a word or group, else after one."""
    pattern = re.sub(r"\\b(?=[a-z(])", lambda _: "(?<![A-Za-z0-9_])", pattern)
    return pattern.replace("\\b", "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def subject_of(text: Column) -> Column:
    """A subject if exactly one pattern names it, else the phrase of the first "my ... is"; null for long texts and unclear ones."""

    def named(low: Column) -> Column:
        hits = F.filter(F.array(*(F.when(low.rlike(java(p)), F.lit(s)) for s, p in SUBJECTS.items())), lambda h: h.isNotNull())
        phrase = F.filter(F.split(F.regexp_extract(low, java(OWNED), 1), "\\s+"), lambda w: (w != "") & ~w.isin(*NOT_KEY))
        key = let(phrase, lambda p: F.when((F.size(p) >= 2) | ((F.size(p) == 1) & (F.length(F.get(p, F.lit(0))) >= 3)), F.array_join(p, "-")))
        return let(hits, lambda h: F.when(F.size(h) == 1, F.get(h, F.lit(0))).when(F.size(h) == 0, key))

    return F.when(F.length(text) <= MOST_CHARS, let(F.lower(text), named))


def type_of(text: Column) -> Column:
    low = F.lower(text)
    # the pattern "is a " ends with a space, so only its start has a boundary
    return F.when(low.rlike(java(f"\\b(?:{IDENTITY})\\b")), "identity").when(low.rlike(bounded(PREFERENCE)), "preference")


def suits_model(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit("\\p{L}"))
    return F.coalesce((letters == 0) | (F.regexp_count(text, F.lit("\\p{IsLatin}")) >= LATIN_SHARE * letters), F.lit(True))
