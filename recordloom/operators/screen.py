"""The screen before the store: an ordered cascade of rules over a text.

The first rule that fires decides: too short, too long, credential, pleasantry, no statement, question,
passing state. Null texts count as empty. Lengths are code points. The credential rules are this
engine's own: known shapes; a value assigned to a credential word; a long token of high entropy with
lower and upper case letters and digits near a credential word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import bounded, let, trim, words

LEAST, MOST = 4, 32_000
# Word lists of the rules.
PLEASANTRIES = ["hi", "hello", "hey", "thanks", "thank you", "ok", "okay", "k", "cool", "nice", "lol", "yes", "no", "sure", "yep", "nope", "bye"]
FILLER = "a an the and or but so of to in on at is are was were be it its this that there here".split()
PLACEHOLDERS = (
    "test testing tests asdf asdfasdf qwerty foo bar baz blah xxx yyy zzz abc 123 hmm hmmm dummy sample "
    "placeholder lorem ipsum todo tbd n/a na none null undefined whatever stuff thing things"
).split()
# Patterns of the rules; the boundaries are added where they are used.
ASKING = "what|whats|what's|when|where|who|whom|whose|which|why|how"
HELPING = "is|are|was|were|am|do|does|did|can|could|should|would|will|shall|has|have|had|may|might"
PASSING = "right now|at the moment|at present|just now|for now|as of (?:right )?now|as we speak|at this moment|currently feeling"
PASSING_FA = "الان|همین الان|در حال حاضر"
CONDITIONS = "raining|snowing|drizzling|pouring|sunny|cloudy|overcast|foggy|windy|humid|hot|cold"
WEATHER = f"(?:it'?s|it is|its)\\s+(?:{CONDITIONS})|raining|snowing|drizzling|pouring|weather (?:in|is|today)"
DEGREES = "-?[0-9]{1,2}\\s?°\\s?[cf]"
QUESTION_MARKS = "[?؟？]"
SENTENCE_ENDS = "[.!?؟。]"
SECRET_SHAPES = "sk-[A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{4,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|[Bb]earer [A-Za-z0-9._~+/-]{20,}"
SECRET_WORDS = "password|passwd|passphrase|passcode|api[ _-]?key|secret[ _-]?key|access[ _-]?key|private[ _-]?key|access[ _-]?token|auth[ _-]?token|secret|token|credentials?"
SECRET_VALUE = "[A-Za-z0-9_+/.!@#$%^&*-]*[0-9][A-Za-z0-9_+/.!@#$%^&*-]*"
ASSIGNED = f"(?:{SECRET_WORDS})(?: (?:for|to|of|on) [A-Za-z0-9._-]{{1,30}})?\\s*(?:[:=]|is)\\s*[\"'`]?(?:{SECRET_VALUE})"
ENTROPY_FLOOR, TOKEN_LEAST = 3.5, 20
# What a text must contain before these patterns are tried; each alternative of a pattern has one of them.
SHAPE_PARTS = ["sk-", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_", "xox", "eyJ", "-----BEGIN ", "earer "]
WORD_PARTS = ["pass", "key", "token", "secret", "credential"]

RULES = ["too_short", "too_long", "credential", "pleasantry", "no_statement", "question", "passing"]
REDACTED = ["too_long", "credential"]


def entropy(token: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(token)
    chars = F.array_distinct(F.filter(F.split(token, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n
    return F.aggregate(chars, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def has_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in parts))


def has_secret(text: Column, low: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9_+/=-]{{{TOKEN_LEAST},}}"), F.lit(0))
    mixed = lambda t: t.rlike("[a-z]") & t.rlike("[A-Z]") & t.rlike("[0-9]") & (entropy(t) >= ENTROPY_FLOOR)
    # the words of a credential come first: most texts have none, and then neither a value nor a context
    worded = has_any(low, WORD_PARTS) & (low.rlike(f"(?<![a-z0-9_]){ASSIGNED}") | (low.rlike(bounded(SECRET_WORDS)) & F.exists(tokens, mixed)))
    return has_any(text, SHAPE_PARTS) & text.rlike(SECRET_SHAPES) | worded


def no_statement(tokens: Column) -> Column:
    return (F.size(tokens) < 2) | F.forall(tokens, lambda t: t.isin(*FILLER, *PLACEHOLDERS))


def is_question(text: Column, low: Column) -> Column:
    opens = low.rlike(f"^(?:{ASKING}|{HELPING})(?![A-Za-z0-9_])")
    single = ~F.substring(text, F.lit(1), F.length(text) - 1).rlike(SENTENCE_ENDS)
    return text.rlike(f"{QUESTION_MARKS}\\z") & (opens | single)


def is_passing(low: Column) -> Column:
    return low.rlike(bounded(f"{PASSING}|{WEATHER}")) | low.rlike(PASSING_FA) | low.rlike(f"{DEGREES}(?![A-Za-z0-9_])")


def verdict(text: Column | str = "text", type_: Column | str = "type") -> Column:
    """struct(ok boolean, rule string, redact boolean, n int): rule is null if the text may be stored; n is its trimmed length."""
    text, type_ = (F.col(c) if isinstance(c, str) else c for c in (text, type_))

    def judged(t: Column, low: Column) -> Column:
        n = F.length(t)
        rule = (
            F.when(n < LEAST, "too_short").when(n > MOST, "too_long").when(has_secret(t, low), "credential").when(low.isin(*PLEASANTRIES), "pleasantry")
            .when(no_statement(words(low)), "no_statement").when(is_question(t, low), "question").when(type_.isNull() & is_passing(low), "passing")
        )
        return let(rule, lambda r: F.struct(r.isNull().alias("ok"), r.alias("rule"), F.coalesce(r.isin(*REDACTED), F.lit(False)).alias("redact"), n.alias("n")))

    return let(trim(F.coalesce(text, F.lit(""))), lambda t: let(F.lower(t), lambda low: judged(t, low)))


def logged_text(text: Column, redact: Column) -> Column:
    return F.when(redact, F.concat(F.lit("[redacted: "), F.length(text).cast("string"), F.lit(" characters]"))).otherwise(text)
