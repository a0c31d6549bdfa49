"""Personal information inside free text.

Regular expressions propose spans, checksum validators (Luhn, mod-97, mod-11 and letter tables) raise
or confirm their score, and context words nearby raise or lower it. Spans of at least THRESHOLD
survive; of overlapping ones the better kind, then the longer wins. Each is replaced by a typed
placeholder and the rest of the text stays as it was.

Kinds: email, phone, id_number, address, name, and card and iban (payment numbers confirmed by their
checksum, which are no id_number but must not pass for a phone either).

Null texts give no spans and a null masked text; empty texts stay empty; very long texts are read
whole; repeated rows give repeated results. Other columns are left alone.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
KINDS = ("email", "phone", "id_number", "address", "name")
_RANK = {k: i for i, k in enumerate(("email", "iban", "card", "id_number", "phone", "address", "name"))}
MOST_NAMES = 100_000  # entries of the list of given names that is sent to the executors


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# ---- e-mail addresses -------------------------------------------------------------------------

# An address is found from its at sign outwards: its local part is read backwards, its domain forwards, both over
# classes of characters disjoint from what separates them, so each character is read a bounded number of times.
_AT = r"(?:@|＠|﹫|\s?[\[({<]\s?(?:at|AT|@|arroba|æt)\s?[\])}>]\s?|\s(?:AT|at)\s(?=[\w-]+(?:\s(?:dot|DOT)\s|\s?[\[({]\s?(?:dot|DOT)\s?[\])}])))"
_DOT = r"(?:\.|．|\s?[\[({<]\s?(?:dot|DOT|punkt|point|punto|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
AT_SIGN = re.compile(_AT)
# The local part written backwards, with its spelled dots.
LOCAL = re.compile(r"[\w.+'%-]++(?:(?:．|\s?[\])}>]\s?(?:tod|TOD|tknup|tniop|otnup|\.)\s?[\[({<]\s?|\s(?:tod|TOD)\s)[\w.+'%-]++)*+")
DOMAIN = re.compile(rf"[\w-]++(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,24}}(?![\w@])")
EMAIL_HINT = re.compile(r"@|＠|﹫|[\[({<]\s?(?:at|AT|arroba)\s?[\])}>]|\s(?:at|AT)\s[\w-]+\s?[\[({]?\s?(?:dot|DOT)")



def emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the addresses of a text."""
    free = 0  # nothing before it belongs to an address
    for m in AT_SIGN.finditer(text):
        local = LOCAL.match(text[free : m.start()][::-1])
        domain = local and DOMAIN.match(text, m.end())
        start = m.start() - local.end() if local else 0
        while local and start < m.start() and not (text[start].isalnum() or text[start] == "_"):
            start += 1
        if domain and start < m.start():
            yield start, domain.end()
            free = domain.end()
        else:
            free = m.end()


# ---- numbers ----------------------------------------------------------------------------------

NUMBER = re.compile(r"(?<![\w.,:/-])(?:tel:\s?)?(?:\+|\(\+?|00)?\d[\d\s().\-/ ‐-–]{5,24}\d(?![\w])(?![-:/]\d)")
PHONE_SHAPE = re.compile(
    r"""(?:tel:)?(?:
      (?:\+|00)\d{1,3}[\s.\-/()]*(?:\(0\)[\s.\-]*)?\d[\d\s.\-/()]{5,16}\d     # international
    | 1?[\s.\-]?\(?[2-9]\d\d\)?[\s.\-]\d{3}[\s.\-]\d{4}                       # North American
    | \([2-9]\d\d\)\s?\d{3}[\s.\-]\d{4}
    | 0\d{1,5}[\s.\-/]?\d{2,8}(?:[\s.\-]\d{2,8}){0,3}                          # national, with trunk 0
    | \(0\d{1,5}\)[\s.\-/]?\d{2,8}(?:[\s.\-]\d{2,8}){0,3}
    | [6-9]\d{2}(?:[\s.\-]\d{3}){2}                                          # Iberian
    )""",
    re.VERBOSE,
)
DATE_LIKE = re.compile(r"(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d\d")
PHONE_WORDS = re.compile(r"\b(?:tel|telephone|téléphone|telefon|teléfono|phone|mobile|mobil|móvil|cell|handy|call|ring|whatsapp|sms|text|fax|number is|dial|reach)\b|tel:|☎", re.I)
NOT_PHONE = re.compile(r"\b(?:order|ticket|invoice|version|build|isbn|hash|commit|entry|file|code|room|port|serial|sku|ref|case|issue|release|tracking)\b[\w\s.#:-]{0,8}$", re.I)

ID_WORDS = re.compile(
    r"""\b(?:passports?|passeport|pasaporte|reisepass|passaporto
    | (?:national\s)?(?:identity|id)[\s-]?cards?|personalausweis(?:nummer)?|ausweis(?:nummer)?|carte\s(?:nationale\s)?d[’']?\s?identit[ée]|cni|dni|nie|nif|documento\sde\sidentidad
    | dri(?:ver|ving)[’']?s?[\s-]+licen[cs]e|f[üu]hrerschein(?:nummer)?|permis\sde\sconduire|(?:permiso|licencia|carn[ée]t?)\sde\sconducir
    | tax[\s-]?(?:id|number|payer\sid|identification)|taxpayer|tin|itin|steuer[\s-]?(?:id|nummer|identifikationsnummer)|num[ée]ro\sfiscal|utr|codice\sfiscale
    | ssn|social[\s-](?:security|insurance)|sozialversicherung\w*|s[ée]curit[ée]\ssociale|seguridad\ssocial|nir|sin
    | national[\s-]insurance|nino?|ni)\b
    (?:[\s-]?(?:card|number|num|no|nr|n[°ºo]|num[ée]ro|nummer|id)\b\.?|\s?n[°º])*[\s.:#=°º]*(?:is\s|ist\s|est\s|es\s)?\s*""",
    re.I | re.VERBOSE,
)
SHORT_ID = frozenset(["ni", "nir", "sin", "nie", "nif", "tin", "utr", "cni", "dni"])
DIGIT = re.compile(r"\d")
SPACE = re.compile(r"\s")
ID_VALUE = re.compile(r"(?=[A-Z0-9 ./-]{0,60}\d)[A-Z0-9]{1,16}(?:[ ./-]?[A-Z0-9]*\d[A-Z0-9]*){0,5}(?:[ -][A-Z])?(?![\w])")
ID_SHAPES = [
    # shape, validator; alone they are not enough, unless the validator confirms them
    (re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), None),
    (re.compile(r"(?<![\w-])(?:\d{8}|[XYZ]\d{7})-?[A-Z](?![\w-])"), "dni"),
    (re.compile(r"(?<![\w-])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d\d\s?\d\d\s?\d\d\s?[A-D](?![\w-])"), "shape"),
    (re.compile(r"(?<![\w-])[12]\s?\d\d\s?(?:0[1-9]|1[0-2])\s?\d\d\s?\d{3}\s?\d{3}\s?\d\d(?![\w-])"), "nir"),
]
# The letters of the Spanish identity number by remainder of 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def dni_letter(value: str) -> bool:
    digits = value[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")
    return DNI_LETTERS[int(digits) % 23] == value[-1]


def nir_key(digits: str) -> bool:
    return 97 - int(digits[:13]) % 97 == int(digits[13:])


# ---- street addresses -------------------------------------------------------------------------

# Words for streets.
STREET_EN = "street|st|road|rd|avenue|ave|drive|dr|close|court|ct|lane|ln|boulevard|blvd|way|place|pl|terrace|square|sq|crescent|cres|parkway|pkwy|highway|hwy|circle|row|mews|walk|grove|gardens|hill|quay"
STREET_DE = "straße|strasse|str\\.?|weg|platz|allee|gasse|ufer|damm|ring|chaussee|steig|stieg"
STREET_FR = "rue|avenue|boulevard|bd|place|quai|impasse|chemin|allée|allee|cours|passage|square|route"
STREET_ES = "calle|c/|avda\\.?|avenida|plaza|paseo|camino|carrera|carretera|ronda|travesía|rúa|via|viale|piazza|corso|rua"
BOX = "p\\.?\\s?o\\.?\\s?box|post\\s?box|postfach|apartado(?:\\sde\\scorreos)?|boîte\\spostale|casella\\spostale|b\\.?p\\.?"
_L = r"[^\W\d_]"
ADDRESS = [
    re.compile(rf"\b(?:(?:apt|apartment|flat|unit|suite)\.?\s\d+[a-z]?,?\s)?(?<![\d.,:/-])\d{{1,5}}\s?(?:[a-h]\b)?\s(?:(?-i:[A-ZÀ-Þ])[\w'’.-]{{0,60}}\s){{1,3}}(?:{STREET_EN})\b\.?(?:,?\s(?:apt|apartment|flat|unit|suite)\.?\s\d+[a-z]?)?", re.I),
    re.compile(rf"\b(?-i:[A-ZÀ-Þ])[\w-]{{0,60}}?(?:{STREET_DE})\s?\d{{1,4}}\s?(?:[a-h]\b)?(?:,\s\d{{5}}\s{_L}+)?", re.I),
    re.compile(rf"\b(?-i:[A-ZÀ-Þ])[\w-]+\s(?:straße|strasse|str\.|weg|platz|allee)\s\d{{1,4}}\s?(?:[a-h]\b)?", re.I),
    re.compile(rf"\b\d{{1,4}}\s?(?:bis|ter|quater|[a-d]\b)?,?\s(?:{STREET_FR})\s(?:(?:de|du|des|de\sla|d[’']|l[’'])\s?){{0,4}}{_L}[\w'’-]+", re.I),
    re.compile(rf"(?<!\w)(?:{STREET_ES})\s(?:(?:de|del|de\sla|de\slos)\s)?(?-i:[A-ZÀ-Þ])[\w'’-]+(?:\s(?-i:[A-ZÀ-Þ])[\w'’-]+)?,?\s(?:n[°ºo.]+\s?)?\d{{1,4}}(?:,\s\d{{1,2}}[°ºª]\s?[A-Z]?)?", re.I),
    re.compile(rf"(?<!\w)(?:{BOX})\.?\s\d{{1,6}}\b", re.I),
]
LOWER_EN = re.compile(rf"(?<![\w.,:/-])\d{{1,4}}[a-h]?\s{_L}{{4,}}\s(?:street|road|avenue|drive|court|lane|boulevard|close)\b")
LOWER_REST = re.compile(rf"\b{_L}{{3,}}(?:straße|strasse|str\.|weg|platz|allee)\s?\d{{1,4}}\b|(?<!\w)(?:calle|avda\.?|avenida|plaza|paseo)\s{_L}{{3,}},?\s\d{{1,4}}\b")
ADDRESS_WORDS = re.compile(r"\b(?:lives?|address|adresse|dirección|anschrift|parcels?|deliver|ship|office is|pick-?up|visit|wohnt|habite|vive|resides?)\b", re.I)
NOT_ADDRESS = re.compile(r"\b(?:route|exit|version|room|build|chapter|step)\s*$", re.I)

# ---- names ------------------------------------------------------------------------------------

# Titles before a family name, and words that announce a person.
TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Señor|Señora|Don|Doña|Signor|Signora"
_U = r"(?-i:[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮİĶĹĽŁŃŇŌŐŒŘŚŞŠŢŤŪŮŰŹŻŽ])"
_W = rf"{_U}[^\W\d_]*(?:['’]{_U}?[^\W\d_]+)?"
_NAME = rf"{_W}(?:-{_W}){{0,3}}"
_PART = r"(?:van|von|de|der|den|la|le|del|di|da|du|af|bin|al)\s"
TITLED = re.compile(rf"(?<![\w.])(?:(?:{TITLES})\b\.?|(?-i:M\.))\s(?:{_U}\.\s)?(?:{_PART}){{0,2}}{_NAME}(?:\s{_NAME})?", re.I)
CUES = r"met|reports\sto|partner|calls?\sthem|calls?\s(?:him|her)|contact(?:\sperson)?\sis|goes\sby|made\sout\sto|account\swith|name\sis|married\sto|wife|husband|boss\sis|manager\sis|signed\sby|written\sby|on\sbehalf\sof|attn|kind\sregards|regards|sincerely"
KIN = r"friend|colleague|sister|brother|mother|father|cousin|aunt|uncle|daughter|son|neighbou?r|landlord|landlady|dentist|lawyer|accountant|therapist|teacher|tutor|coach|mentor|flatmate|roommate|fianc[ée]e?|girlfriend|boyfriend|dear"
CUED = re.compile(rf"\b(?:{CUES}|{KIN})[:,]?\s(?P<name>{_NAME},\s{_NAME}|{_NAME}\s(?:{_U}\.\s)?(?:{_PART}){{0,2}}{_NAME})", re.I)
CUED_LOWER = re.compile(r"(?:reports to|partner:|call them|contact is|goes by|made out to|account with|met) (?P<name>(?P<given>[^\W\d_]{4,}) [^\W\d_]{4,})\b")
AFTER_GIVEN = re.compile(rf"(?:-{_W}){{0,3}}\s(?:{_U}\.\s)?(?:{_PART}){{0,2}}({_W}(?:-{_W}){{0,3}})")
AFTER_LOWER = re.compile(r"(?:-[^\W\d_]+){0,3}\s(?:[^\W\d_]\.\s)?([^\W\d_]{3,}(?:-[^\W\d_]+){0,3})")
BEFORE_GIVEN = re.compile(rf"({_W}(?:-{_W}){{0,3}}),\s(?:{_W}-)?$")
BEFORE_LOWER = re.compile(r"([^\W\d_]{3,}(?:-[^\W\d_]+){0,3}),\s$")
# Capitalised words that are no family names.
NOT_FAMILY = frozenset(
    "the this that these those user owner account person team project and or but with from for not also she he they his her their my our your is was has had will would can could "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "last first only every some any please at work now then never always often daily".split()
)


# What a text must contain, in lower case and with any white space for a space, before the patterns of a kind are
# tried. Where a hint ends in a space, anything but a letter may follow it.
HINTS = {
    "id": "passport|passeport|pasaporte|reisepass|passaporto|id card|id-card|idcard|identity|ausweis|identité|identite|cni|dni|nie|nif|identidad|driver|driving|führerschein|fuhrerschein|permis|licencia|carnet|carné|tax|tin|steuer|fiscal|utr|codice|ssn|social|sozial|seguridad|nir |sin |national insurance|nino|ni ",
    "en": "street| st|road| rd|avenue| ave|drive| dr|close|court| ct|lane| ln|boulevard|blvd| way|place| pl|terrace|square| sq|crescent| cres|parkway|pkwy|highway|hwy|circle| row|mews| walk|grove|gardens| hill|quay",
    "de": "straße|strasse|str.|str |weg |platz |allee |gasse |ufer |damm |ring |chaussee |steig |stieg ",
    "fr": " rue | avenue | boulevard | bd | place | quai | impasse | chemin | allée | allee | cours | passage | square | route ",
    "es": "calle |c/ |avda|avenida |plaza |paseo |camino |carrera |carretera |ronda |travesía |rúa |via |viale |piazza |corso |rua ",
    "box": "box |postfach |apartado |postale |b.p. |bp ",
    "title": "|".join(f"{t.lower()} " for t in [*TITLES.split("|"), "M."]),
    "cue": "met |reports to |partner|them |him |her |contact |goes by |made out to |account with |name is |married to |wife |husband |boss is |manager is |signed by |written by |on behalf of |attn|regards|sincerely|friend |colleague |sister |brother |mother |father |cousin |aunt |uncle |daughter |son |neighbor |neighbour |landlord |landlady |dentist |lawyer |accountant |therapist |teacher |tutor |coach |mentor |flatmate |roommate |fianc|girlfriend |boyfriend |dear ",
}
HINT_PARTS = dict.fromkeys(["en", "de", "fr", "es", "box"])
NUMBER_THEN_NAME = re.compile(r"\d\s?[a-h]?\s[A-ZÀ-Þ]")


class Detector:
    """Spans of one text after another; given: the given names in lower case."""

    def __init__(self, given: list[str]):
        words: dict[str, set[tuple[str, bool]]] = {}
        for kind, listed in HINTS.items():
            for w in listed.split("|"):
                words.setdefault(w.rstrip(" "), set()).add((kind, w.endswith(" ")))
        for g in given:
            if g and (g := g.strip().lower()):
                words.setdefault(g, set()).add(("given", False))
        #: how listed given names end; a name in lower case that isn't listed must end like one, and follow a cue
        self.endings = {g.strip().lower()[-3:] for g in given if g and len(g.strip()) > 4}
        self.hints = ahocorasick.Automaton()
        for w, kinds_ in words.items():
            names = {k for k, _ in kinds_} - {"given"}
            anywhere = frozenset(k for k, closed in kinds_ if not closed and k != "given")
            self.hints.add_word(w, (len(w), ("given", False) in kinds_, anywhere, frozenset(names)))
        self.hints.make_automaton()

    def spans(self, text: str | None) -> list[Span]:
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # a few letters change length in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        seen: set[str] = set()
        given: list[tuple[int, int]] = []
        for end, (n, is_given, anywhere, closed) in self.hints.iter(SPACE.sub(" ", low)):
            if is_given:
                given.append((end + 1 - n, end + 1))
            seen |= closed if end + 1 == len(low) or not low[end + 1].isalpha() else anywhere
        found: list[Span] = []
        if EMAIL_HINT.search(text):
            found += [Span(a, b, "email", 0.95) for a, b in emails(text)]
        if DIGIT.search(text):
            self._numbers(text, found, "id" in seen)
            if seen & HINT_PARTS.keys():
                self._addresses(text, found, seen)
        self._names(text, low, found, given, seen)
        kept: list[Span] = []  # in order and apart
        for s in sorted((s for s in found if s.score >= THRESHOLD), key=lambda s: (_RANK[s.kind], s.start - s.end, s.start)):
            at = bisect.bisect_left(kept, s.start, key=lambda k: k.start)
            if (at == 0 or kept[at - 1].end <= s.start) and (at == len(kept) or s.end <= kept[at].start):
                kept.insert(at, s)
        return kept

    def _numbers(self, text: str, found: list[Span], ids: bool) -> None:
        for m in IBAN.finditer(text):
            if mod97(re.sub(r"\s", "", m.group())):
                found.append(Span(m.start(), m.end(), "iban", 0.95))
        for m in CARD.finditer(text):
            d = re.sub(r"\D", "", m.group())
            if luhn(d) and d[0] in "3456":
                found.append(Span(m.start(), m.end(), "card", 0.9))
        for m in ID_WORDS.finditer(text) if ids else ():
            v = ID_VALUE.match(text, m.end())
            # short words such as "ni" or "sin" count in capitals only
            word = text[m.start() : m.end()].split()[0].strip(".:#")
            if v and sum(map(str.isdigit, v.group())) >= 4 and (word.lower() not in SHORT_ID or word.isupper()):
                found.append(Span(v.start(), v.end(), "id_number", 0.9))
        for shape, check in ID_SHAPES:
            for m in shape.finditer(text):
                compact = re.sub(r"[\s-]", "", m.group())
                score = 0.35
                if check == "shape" or check == "dni" and dni_letter(compact) or check == "nir" and nir_key(compact):
                    score = 0.6
                before = text[max(0, m.start() - 40) : m.start()]
                score += 0.3 * bool(ID_WORDS.search(before)) - 0.3 * bool(NOT_PHONE.search(before))
                found.append(Span(m.start(), m.end(), "id_number", score))
        for m in NUMBER.finditer(text):
            begin = m.start()
            while begin and text[begin - 1] in "+(":
                begin -= 1
            if text[max(0, begin - 4) : begin].lower() == "tel:":
                begin -= 4
            elif begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.,:/-"):
                continue
            s = text[begin : m.end()]
            n = sum(map(str.isdigit, s))
            if not 7 <= n <= 16 or DATE_LIKE.search(s):
                continue
            p = PHONE_SHAPE.match(s)
            if p is None and " " in s and s[0].isdigit():
                # another number comes before the phone
                p = PHONE_SHAPE.match(s, s.index(" ") + 1)
                if p and sum(map(str.isdigit, p.group())) < 9:
                    p = None
            if not p or not 7 <= sum(map(str.isdigit, p.group())) <= 15:
                continue
            start, end = begin + p.start(), begin + p.end()
            before, after = text[max(0, start - 30) : start], text[end : end + 12]
            nd = sum(map(str.isdigit, p.group()))
            score = 0.45 + 0.2 * (p.group()[0] in "+(t" or nd >= 10) + 0.15 * (p.group()[0] == "0") + 0.3 * bool(PHONE_WORDS.search(before))
            score -= 0.6 * bool(NOT_PHONE.search(before)) + 0.3 * bool(re.match(r"\s?(?:rows|units|items|days|hours|chars|tokens)", after))
            found.append(Span(start, end, "phone", score))

    def _addresses(self, text: str, found: list[Span], seen: set[str]) -> None:
        patterns = [ADDRESS[i] for i, k in enumerate(("en", "de", "de", "fr", "es", "box")) if k in seen and (k != "en" or NUMBER_THEN_NAME.search(text))]
        if ADDRESS_WORDS.search(text):
            patterns += [LOWER_EN] * ("en" in seen) + [LOWER_REST] * bool(seen & {"de", "es"})
        for pattern in patterns:
            for m in pattern.finditer(text):
                before = text[max(0, m.start() - 40) : m.start()]
                found.append(Span(m.start(), m.end(), "address", 0.6 + 0.2 * bool(ADDRESS_WORDS.search(before)) - 0.4 * bool(NOT_ADDRESS.search(before))))

    def _names(self, text: str, low: str, found: list[Span], given: list[tuple[int, int]], seen: set[str]) -> None:
        for m in TITLED.finditer(text) if "title" in seen else ():
            parts = m.group().split()
            if parts[-1].lower() not in NOT_FAMILY:
                found.append(Span(m.start(), m.end(), "name", 0.8))
            elif len(parts) > 2:
                found.append(Span(m.start(), m.end() - len(parts[-1]) - 1, "name", 0.8))
        for m in CUED.finditer(text) if "cue" in seen else ():
            if not NOT_FAMILY & {w.lower() for w in re.split(r"[\s,-]+", m.group("name"))}:
                found.append(Span(m.start("name"), m.end("name"), "name", 0.7))
        for m in CUED_LOWER.finditer(low) if "cue" in seen else ():
            if text[m.start("name")].islower() and m.group("given")[-3:] in self.endings and not NOT_FAMILY & set(m.group("name").split()):
                found.append(Span(m.start("name"), m.end("name"), "name", 0.55))
        for start, stop in given:
            if (start and (low[start - 1].isalnum() or low[start - 1] in "@_")) or (stop < len(low) and (low[stop].isalnum() or low[stop] in "@_")):
                continue
            proper = text[start].isupper()
            a = (AFTER_GIVEN if proper else AFTER_LOWER).match(text, stop)
            if a and a.group(1).lower() not in NOT_FAMILY and len(a.group(1)) > 1:
                found.append(Span(start, a.end(), "name", 0.9 if proper else 0.6))
                continue
            before = text[max(0, start - 60) : start]
            b = (BEFORE_GIVEN if proper else BEFORE_LOWER).search(before) if "," in before else None
            if b and b.group(1).lower() not in NOT_FAMILY:
                found.append(Span(start - len(before) + b.start(), stop, "name", 0.75))


def mask(text: str | None, spans: list[Span]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def _given(names: DataFrame) -> list[str]:
    got = [r[0] for r in names.select("given").where("given is not null").limit(MOST_NAMES + 1).collect()]
    if len(got) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names")
    return got


def detect(df: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """(row_key long, spans array<struct<start int, end int, kind string, score float>>, masked string) of df(key, text)."""
    given = df.sparkSession.sparkContext.broadcast(_given(names))  # at most MOST_NAMES strings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Detector(given.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float32())]))
        for b in batches:
            texts = b.column(1).to_pylist()
            spans = [finder.spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[s._asdict() for s in x] for x in spans], kind), pa.array([mask(t, x) for t, x in zip(texts, spans, strict=True)], pa.string())], names=["row_key", "spans", "masked"])

    return df.select(F.col(key).cast("long"), "text").mapInArrow(run, "row_key long, spans array<struct<start:int,end:int,kind:string,score:float>>, masked string")


def kinds(df: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """(row_key, kind): one row for each kind in each text."""
    return detect(df, key, names).select("row_key", F.explode(F.array_distinct(F.col("spans.kind"))).alias("kind")).where(F.col("kind").isin(*KINDS))


def found(memories: DataFrame, gate_log: DataFrame, names: DataFrame) -> DataFrame:
    both = [kinds(df, key, names).withColumn("table_name", F.lit(name)) for df, key, name in ((memories, "seq", "memories"), (gate_log, "line_no", "gate_log"))]
    return both[0].unionByName(both[1]).select("table_name", "row_key", "kind")
