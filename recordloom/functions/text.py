"""Text as column expressions: trimming, folding, words, stems, trigrams.

Null in, null out. JavaScript's notion of white space is used for trimming, ASCII word boundaries for
patterns; both are spelled out because the JVM's differ.
"""

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Scripts written without spaces; each of their characters is a word.
SINGLES = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}"
# Words without meaning of their own in a search.
STOPWORDS = (
    "a an and are as at be by do does for from has have how i in is it its me my of on "
    "or so that the their them they this to was were what when where which who why with you your"
).split()
FUZZY_FLOOR = 0.4


def bounded(pattern: str) -> str:
    """A pattern between ASCII word boundaries."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(c: Column | str) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(SPACES))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(trim(c), F.lit(""))


def fold_text(text: str | None) -> str | None:
    """Decomposed, without marks, recomposed, in lower case."""
    if text is None or text.isascii():
        return text.lower() if text else text
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", text) if unicodedata.category(ch)[0] != "M")
    return unicodedata.normalize("NFC", plain).lower()


def fold(c: Column) -> Column:
    """fold_text of a column; Spark has no normaliser of its own."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(fold_text, na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def words(c: Column) -> Column:
    """Runs of letters and digits; of scripts without spaces each character."""
    return F.regexp_extract_all(c, F.lit(f"[{SINGLES}]|(?:(?![{SINGLES}])[\\p{{L}}\\p{{N}}])+"), F.lit(0))


def stem(c: Column) -> Column:
    """A few English endings off, where enough is left. The patterns are tried only on words that end so."""
    one = lambda w: F.when(w.endswith("ing") | w.endswith("ed") | w.endswith("ly"), F.regexp_replace(w, "^(.{3,}?)(?:ing|edly|ed|ly)$", "$1")).otherwise(w)
    two = lambda w: F.when(w.endswith("ies"), F.regexp_replace(w, "^(.{2,})ies$", "$1y")).otherwise(w)
    three = lambda w: F.when(w.endswith("s"), F.regexp_replace(w, "^(.{3,}?)(?:es|s)$", "$1")).otherwise(w)
    return let(let(let(c, one), two), three)


def content_stems(folded: Column) -> Column:
    """Stems of the words that aren't stopwords, or of all if there are no others."""
    kept = lambda every: let(F.filter(every, lambda w: ~w.isin(*STOPWORDS)), lambda some: F.when(F.size(some) > 0, some).otherwise(every))
    return F.transform(let(words(folded), kept), stem)


def trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of the trigrams; 1 for equal texts, 0 if one is empty."""
    dice = lambda ga, gb: 2.0 * F.size(F.array_intersect(ga, gb)) / (F.size(ga) + F.size(gb))
    grams = lambda x, y: let(trigrams(x), lambda ga: let(trigrams(y), lambda gb: dice(ga, gb)))
    return let(a, lambda x: let(b, lambda y: F.when(x == y, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(grams(x, y))))


def token_similarity(a: Column, b: Column) -> Column:
    s = trigram_similarity(a, b)
    return F.when(a == b, 1.0).when(s >= FUZZY_FLOOR, s).otherwise(0.0)


def cut(c: Column, most: int) -> Column:
    """At most so many characters, and an ellipsis if any are missing."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)
