"""Surrogates for personal data: keyed, of the same type, script and format, distinct and coreferent.

Found: e-mail, IPv4, IPv6 and MAC addresses, payment cards and IBANs whose check digits hold, US social
security numbers, telephone numbers, cloud access keys, values of password-like settings, birth
dates and passport or identity numbers after a word that says so, and persons' names by their signs: a form
of address, a listed given name, a cue before ("my name is", also in lower case; "contact", "regards,") or
a verb after ("wrote", "dijo"). A name's words are then looked for in the whole text: wherever one
stands again, capitalised or in capitals, before or after, it gets the same surrogate. A name without
any such sign in its document is not found.

Wherever found, an entity is replaced by the surrogate of its canonical form (letters in lower case,
digits without separators), written back into the original's own separators and letter case.

A surrogate is a keyed permutation of its format's domain: conjugating a shift by a Feistel cipher,
walked along its cycle into the domain. So different originals of a format get different surrogates
and none maps to itself; where two formats could meet (hexadecimal secrets, example hosts, listed names,
days of a birth), a surrogate walks on until it is of its original's. Card numbers keep
their check digit's state, IBANs theirs, addresses their valid octets, North American numbers their
valid codes; a birth date becomes another real day of its time (1600-1899, 1900-2027, 2028-2199, any
other), digits that are no day others that are none. A listed given name becomes another one listed for
its gender and script; any other word of a name keeps its last letter, where languages mark gender.
`collisions` counts, over a whole table, surrogates that two originals share; should there be any, `checked` and
`anonymise` give all but one of these originals the surrogate of another key, and check again.

Null and empty texts stay as they are. Rows, repeated ones too, map one to one; other columns are
ignored by `surrogates` and carried by `anonymise`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
import warnings
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import fresh, materialise, release, steps

# Given names by gender and script, and forms of address.
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carmen Clara Elena Emma Eva Grace Ines Jane Julia Laura Lucia Maria Marie Mary Nina Olivia Paula Rosa Sarah Sofia Susan".split(),
    ("m", "latin"): "Adam Albert Carlos Daniel David Diego Felix Frank Hans Henri Hugo James John Jose Juan Karl Louis Luis Mark Martin Michael Paul Peter Robert".split(),
    ("f", "cyrillic"): "Анна Вера Елена Ирина Мария Нина Ольга Юлия".split(),
    ("m", "cyrillic"): "Борис Виктор Иван Никита Олег Павел Сергей Юрий".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Г-жа".split(),
    "m": "Mr Herr Monsieur Señor Sr Г-н".split(),
    "n": "Dr Prof Professor".split(),
}
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "áéíóú", "àèìòù", "äöü")
HEX = "0123456789abcdef"
# Words before a person's name, a birth date, an identity document's number.
NAME_CUES = ("my name is", "name:", "signed by", "contact person:", "ich heiße", "je m'appelle", "me llamo")
#: Before two capitalised words, and after them.
BEFORE_CUES = ("contact", "written by", "call", "ask for", "dear", "regards,", "sincerely,", "thanks,", "kontakt", "gez.", "grüße,", "contacter", "cordialement,", "contacte con", "atentamente,")
AFTER_CUES = "wrote|writes|said|says|replied|signed|called|asked|lives|schrieb|sagte|wohnt|écrit|a écrit|habite|escribió|dijo|vive".split("|")
#: Words that are no name beside a cue.
NO_NAMES = frozenset("a an the of on in at to for and or not no is are was were be it this that these those my your his her its our their there here with from by as if so der die das ein eine und oder nicht im am auf zu ist le la les un une et ou pas sur dans de du est el los las una y o en es".split())
BIRTH_CUES = ("born on", "born", "date of birth", "dob", "geboren am", "né le", "née le", "nacido el", "nacida el")
DOCUMENT_CUES = ("passport", "passport no", "passport number", "identity card", "id card", "reisepass", "passeport", "pasaporte")
#: Years whose days are moved among themselves.
TIMES = ((1600, 1899), (1900, 2027), (2028, 2199))
#: In the order of precedence.
KINDS = ("email", "access_key", "secret", "iban", "document", "birth", "mac", "ipv6", "card", "ssn", "ipv4", "phone", "name")
#: The setting that has the secret key of the surrogates.
KEY_SETTING = "spark.tessera.surrogate.key"
#: Colliding originals that one round of repairs takes.
MOST_REPAIRS = 100_000
#: For the given example tables, where that is unset. Whoever knows a key can undo its surrogates.
EXAMPLE_KEY = b"tessera public example key"

_CLASS = {c: a for a in ALPHABETS for c in a}
_NAMES = {n.lower(): (g, s) for (g, s), names in GIVEN.items() for n in names}
_TITLE = {t.lower(): g for g, ts in TITLES.items() for t in ts}
_CAP = r"[^\W\d_a-zß-öø-ÿа-я][^\W\d_]+"
_LOW = r"[^\W\d_A-ZÀ-ÞА-Я][^\W\d_]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9](?:[\w.%+-]*[A-Za-z0-9])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])",
    "access_key": r"(?<!\w)A[KS]IA[A-Z0-9]{16}(?!\w)",
    "secret": r"(?<!\w)(?i:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?(?P<value>[^\s,;\"']{4,})",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "document": rf"(?<!\w)(?i:{'|'.join(DOCUMENT_CUES)})\.?:? (?P<value>[A-Z]{{0,3}}\d{{5,10}}[A-Z]?)(?!\w)",
    "birth": rf"(?<!\w)(?i:{'|'.join(BIRTH_CUES)}):? (?P<value>\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}})(?!\w)",
    "mac": r"(?<![\w:-])[0-9A-Fa-f]{2}(?:([:-])[0-9A-Fa-f]{2})(?:\1[0-9A-Fa-f]{2}){4}(?![\w:-])",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?(?![\w:])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ipv4": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "name": rf"(?<!\w)(?:(?P<title>{'|'.join(t for ts in TITLES.values() for t in ts)})\.? (?:{_CAP} ){{0,2}}{_CAP}|(?:{'|'.join(n for ns in GIVEN.values() for n in ns)}) {_CAP}|(?P<cue>(?i:{'|'.join(map(re.escape, NAME_CUES))})\s){_CAP}(?: {_CAP}){{0,2}}|(?P<near>(?i:{'|'.join(map(re.escape, BEFORE_CUES))})\s){_CAP} {_CAP}|{_CAP} {_CAP}(?= (?:{'|'.join(AFTER_CUES)})(?!\w))|(?P<low>(?i:{'|'.join(map(re.escape, NAME_CUES))})\s)(?P<words>{_LOW}(?: {_LOW}){{1,2}}(?=\s*(?:[.,;!?\n]|$))))(?!\w)",
}
_COMPILED = {kind: re.compile(p) for kind, p in PATTERNS.items()}
#: A text without any of these, or any of the cues, has no such entity; tested before the pattern.
_HINTS = {"email": re.compile("@"), "access_key": re.compile("A[KS]IA"), "secret": re.compile(r"[=:]"), "ipv6": re.compile(":[0-9A-Fa-f]"), "mac": re.compile("[:-][0-9A-Fa-f]{2}[:-]"), "name": re.compile("|".join([t for ts in TITLES.values() for t in ts] + [n for ns in GIVEN.values() for n in ns]) + "| (?:" + "|".join(AFTER_CUES) + ")")}
_CUES = {"name": NAME_CUES + BEFORE_CUES, "birth": BIRTH_CUES, "document": DOCUMENT_CUES}
_DIGIT = re.compile(r"\d")


@lru_cache(maxsize=50_000)
def alphabet(c: str) -> str:
    """The characters that c is moved among: those of its alphabet, or of its script, category and case
    rule in its block of 256 (all of these have the same one); c alone if it is no letter or digit."""
    if c in _CLASS or not c.isalnum():
        return _CLASS.get(c, c)
    first = ord(c) & ~255
    return "".join(x for x in map(chr, range(first, first + 256)) if x not in _CLASS and x.isalnum() and _kind(x) == _kind(c))


@lru_cache(maxsize=5_000)
def symbols(c: str) -> str:
    """The characters that c, alone in its alphabet, is moved among: those of its block of 256 that are alone
    too; in a block with no other such, those of all such blocks. White space and delimiters stay."""
    block = _alone(ord(c) >> 8)
    return c if c not in block else block if len(block) > 1 else _lonely()


def _alone(block: int) -> str:
    found = map(chr, range(block << 8, (block + 1) << 8))
    return "".join(x for x in found if not 0xD800 <= ord(x) < 0xE000 and x.isprintable() and not x.isspace() and x not in ",;\"'" and len(alphabet(x)) == 1)


@lru_cache(maxsize=1)
def _lonely() -> str:
    return "".join(x for x in map(_alone, range(0x110000 >> 8)) if len(x) == 1)


def _day(text: str) -> int | None:
    """The ordinal of the day YYYYMMDD, if it is one."""
    try:
        return date(int(text[:4]), int(text[4:6]), int(text[6:])).toordinal()
    except ValueError:
        return None


def _kind(c: str) -> tuple:
    """Script, category, and whether c comes back from the other case."""
    both = len(c.upper()) == len(c.lower()) == 1 and c in (c.lower(), c.upper()) and c.upper().lower() == c.lower()
    return unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), both


def _lower(text: str) -> str:
    """Lower case with a character for each character."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _ascii_digits(text: str) -> str:
    """Decimal digits of any script as 0-9."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def _digit_like(s: str, c: str) -> str:
    """The digit s, 0-9, in the script of the digit c; anything else stays."""
    return chr(ord(c) - unicodedata.decimal(c) + int(s)) if c.isdecimal() and s.isdecimal() else s


class Surrogates:
    """The keyed maps. One object a worker; results depend on the key alone."""

    def __init__(self, key: bytes, repairs: dict[tuple[str, str], int] | None = None):
        self.key, self.repairs = key, repairs or {}
        self.replace = lru_cache(maxsize=50_000)(self._replace)

    def sign(self, canonical: str) -> str:
        """A keyed digest of an original."""
        return hmac.new(self.key, canonical.encode(), hashlib.sha256).hexdigest()

    def _shift(self, number: int, size: int, domain: str) -> int:
        """A keyed permutation of 0..size-1 without fixed points (none of a domain of one)."""
        if size < 2:
            return number
        step = 1 + int.from_bytes(hmac.digest(self.key, f"step|{domain}|{size}".encode(), "sha256"), "big") % (size - 1)
        return self._cipher((self._cipher(number, size, domain, False) + step) % size, size, domain, True)

    def _cipher(self, number: int, size: int, domain: str, back: bool) -> int:
        half = max(1, -(-(size - 1).bit_length() // 2))
        mask = (1 << half) - 1
        rounds = range(7, -1, -1) if back else range(8)
        while True:
            left, right = number >> half, number & mask
            for r in rounds:
                if back:
                    left, right = right ^ self._round(left, r, half, domain), left
                else:
                    left, right = right, left ^ self._round(right, r, half, domain)
            number = left << half | right
            if number < size:
                return number

    def _round(self, value: int, r: int, half: int, domain: str) -> int:
        data = f"{domain}|{r}|{value}|{half}".encode()
        return int.from_bytes(hmac.digest(self.key, data, "sha256"), "big") & ((1 << half) - 1)

    def spell(self, text: str, alphabets: list[str], domain: str) -> str:
        """Each character moved within its alphabet (one of a single character stays), as one number."""
        number, size = 0, 1
        for c, a in zip(text, alphabets, strict=True):
            number, size = number * len(a) + a.index(c), size * len(a)
        number = self._shift(number, size, domain + "|" + "/".join(a if len(a) == 1 else f"{a[0]}{len(a)}" for a in alphabets))
        out = []
        for a in reversed(alphabets):
            number, k = divmod(number, len(a))
            out.append(a[k])
        return "".join(reversed(out))

    def by_class(self, text: str, domain: str) -> str:
        return self.spell(text, [alphabet(c) for c in text], domain)

    def _replace(self, kind: str, canonical: str) -> str:
        again = self.repairs.get((kind, self.sign(canonical)), 0) if self.repairs else 0
        if again:
            return Surrogates(self.key + b"|%d" % again)._replace(kind, canonical)
        if not canonical or any(len(alphabet(c)) > 1 for c in canonical):
            return getattr(self, "_" + kind)(canonical)
        # no letter or digit that has another to move to: symbols move among symbols, which no other original gets
        return self.spell(canonical, [symbols(c) for c in canonical], kind + "|symbols")

    def _until(self, move: Callable[[str], str], text: str, fits: Callable[[str], bool]) -> str:
        """text moved on until it fits; one to one on all texts that fit, as `move` is on its domain."""
        while True:
            text = move(text)
            if fits(text):
                return text

    def _email(self, text: str) -> str:
        local, _, host = text.partition("@")
        labels = host.split(".")
        # reserved example domains and the top level stay, so no real host is named by chance
        keep = 2 if len(labels) > 1 and labels[-2] == "example" else 1
        head = ".".join(labels[:-keep])
        domain = "email|" + ".".join(labels[-keep:])
        real = lambda x: keep == 2 or x.rpartition("@")[2].rpartition(".")[2] != "example"
        both = self._until(lambda x: self.by_class(x, domain), local + "@" + head, real)
        return both + ("." if head else "") + ".".join(labels[-keep:])

    def _ipv4(self, text: str) -> str:
        parts = [int(x) for x in text.split(".")]
        firsts = list(range(1, 224)) if 1 <= parts[0] <= 223 else [0, *range(224, 256)]
        number = firsts.index(parts[0])
        for x in parts[1:]:
            number = number * 256 + x
        number = self._shift(number, len(firsts) * 256**3, "ipv4")
        return ".".join(map(str, (firsts[number >> 24], number >> 16 & 255, number >> 8 & 255, number & 255)))

    def _card(self, text: str) -> str:
        body = text[0] + self.spell(text[1:-1], ["0123456789"] * (len(text) - 2), "card" + text[0])
        return body + str((_luhn(body) + int(text[-1]) - _luhn(text[:-1])) % 10)

    def _ssn(self, text: str) -> str:
        return self.by_class(text, "ssn")

    def _iban(self, text: str) -> str:
        body = self.spell(text[4:], ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text[4:]], "iban" + text[:2])
        off = (int(text[2:4]) - _iban_check(text[:2], text[4:])) % 97
        return f"{text[:2]}{(_iban_check(text[:2], body) + off) % 97:02d}{body}"

    def _phone(self, text: str) -> str:
        """Canonical: national number of ten digits for North America, else + and all digits."""
        if text[0] == "+":
            head = min(3, max(1, len(text) - 7))
            return text[: 1 + head] + self.by_class(text[1 + head :], "phone" + text[1 : 1 + head])
        return self.spell(text, ["23456789" if i in (0, 3) and c in "23456789" else "01" if i in (0, 3) else "0123456789" for i, c in enumerate(text)], "phone")

    def _access_key(self, text: str) -> str:
        return text[:4] + self.spell(text[4:], ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * (len(text) - 4), "access" + text[:4])

    def _secret(self, text: str) -> str:
        if set(text) <= set(HEX):
            return self.spell(text, [HEX] * len(text), "secret|hex")
        wide = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
        alphabets = [next((a for a in wide if c in a), None) or alphabet(c) for c in text]
        return self._until(lambda x: self.spell(x, alphabets, "secret"), text, lambda x: not set(x) <= set(HEX))

    def _document(self, text: str) -> str:
        return self.spell(text, ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text], "document")

    def _birth(self, text: str) -> str:
        """Canonical YYYYMMDD: another real day of its time; what is no day, other digits that are none."""
        day = _day(text)
        if day is None:
            return self._until(lambda x: self.spell(x, ["0123456789"] * 8, "no day"), text, lambda x: _day(x) is None)
        for first, last in TIMES:
            low, high = date(first, 1, 1).toordinal(), date(last, 12, 31).toordinal()
            if low <= day <= high:
                break
        else:  # any other time
            taken = [(date(a, 1, 1).toordinal(), date(b, 12, 31).toordinal()) for a, b in TIMES]
            move = lambda x: self._shift(x - 1, date.max.toordinal(), "birth|other") + 1
            made = move(day)
            while any(a <= made <= b for a, b in taken):
                made = move(made)
            other = date.fromordinal(made)
            return f"{other.year:04d}{other.month:02d}{other.day:02d}"
        made = date.fromordinal(low + self._shift(day - low, high - low + 1, f"birth|{first}"))
        return f"{made.year:04d}{made.month:02d}{made.day:02d}"

    def _mac(self, text: str) -> str:
        return self.spell(text, [HEX] * 12, "mac")

    def _ipv6(self, text: str) -> str:
        return self.spell(text, [HEX if c in HEX else c for c in text], "ipv6")

    def _name(self, text: str) -> str:
        """A listed name: another of its gender and script. Else its letters but the last, which may
        mark gender, moved within their class and script; walks past listed names, which keeps the
        map one to one on all the others."""
        if text in _NAMES:
            names = GIVEN[_NAMES[text]]
            at = [n.lower() for n in names].index(text)
            return names[self._shift(at, len(names), "given|" + "|".join(_NAMES[text]))].lower()
        kept = 1 if len(text) > 3 and any(len(alphabet(c)) > 1 for c in text[:-1]) else 0
        out = text
        while True:
            alphabets = [alphabet(c) for c in out[: len(out) - kept]] + list(out[len(out) - kept :])
            out = self.spell(out, alphabets, "name")
            if out not in _NAMES:
                return out


def _luhn(body: str) -> int:
    """The check digit of a card number's other digits."""
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _valid(kind: str, text: str) -> bool:
    """Whether the check digits of a card number or IBAN hold."""
    if kind == "card":
        digits = re.sub(r"\D", "", _ascii_digits(text))
        return _luhn(digits[:-1]) == int(digits[-1])
    if kind == "iban":
        plain = _ascii_digits(text).replace(" ", "")
        return _iban_check(plain[:2], plain[4:]) == int(plain[2:4])
    return True


def _name_words(text: str) -> list[tuple[int, int]]:
    """The words of a name that are not a form of address, as ranges of the text."""
    words = [m.span() for m in re.finditer(r"[^ ]+", text)]
    return [(a, b) for k, (a, b) in enumerate(words) if not (k == 0 and text[a:b].rstrip(".").lower() in _TITLE)]


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, leftmost first, none overlapping; earlier kinds win. Names
    come as whole runs where a sign is, and as single words where one of theirs stands again."""
    low = text.lower()
    kinds = {k for k, hint in _HINTS.items() if hint.search(text)} | {k for k, cues in _CUES.items() if any(c in low for c in cues)}
    if _DIGIT.search(text):
        kinds.update(("iban", "card", "ssn", "ipv4", "phone"))
    if not kinds:
        return []
    kinds = sorted(kinds, key=KINDS.index)
    taken = bytearray(len(text))
    spans: list[tuple[int, int, str]] = []

    def take(a: int, b: int, kind: str) -> bool:
        if taken.find(1, a, b) >= 0:
            return False
        taken[a:b] = b"\1" * (b - a)
        spans.append((a, b, kind))
        return True

    words: set[str] = set()
    for kind in kinds:
        for m in _COMPILED[kind].finditer(text):
            a, b = m.span("value") if "value" in m.re.groupindex else m.span()
            if kind == "name":
                a = max(a, *(m.end(g) for g in ("cue", "near", "low")))
                if not m["title"] and NO_NAMES.intersection(text[a:b].lower().split()):
                    continue
            if _valid(kind, text[a:b]) and take(a, b, kind) and kind == "name":
                words.update(_lower(text[a + x : a + y]) for x, y in _name_words(text[a:b]))
    words = {w for w in words if len(w) > 1}
    if words:
        for m in re.finditer(r"[^\W\d_]+", text):
            word = m[0]
            if (word[0].isupper() or not word[0].islower()) and _lower(word) in words:
                take(*m.span(), "name")
    return sorted(spans)


def _canonical(kind: str, text: str) -> str:
    if kind in ("email",):
        return _lower(text)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", _ascii_digits(text))
    if kind == "iban":
        return _ascii_digits(text).replace(" ", "")
    if kind == "ipv4":
        return _ascii_digits(text)
    if kind == "mac":
        return re.sub(r"[:-]", "", text).lower()
    if kind == "ipv6":
        return text.lower()
    if kind == "birth":
        return _birth_parts(text)[0]
    if kind == "phone":
        digits = re.sub(r"\D", "", _ascii_digits(text))
        national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
        return national if len(national) == 10 and (text[0] != "+" or digits[0] == "1") else "+" + digits
    return text


def _birth_parts(text: str) -> tuple[str, str]:
    """(YYYYMMDD, the order of the parts): day before month, unless only the other way is a day."""
    parts = [int(x) for x in re.split(r"[-./]", _ascii_digits(text))]
    orders = ("ymd",) if "-" in text else ("dmy", "mdy")
    read = [("{y:04d}{m:02d}{d:02d}".format(**dict(zip(o, parts, strict=True))), o) for o in orders]
    return next((r for r in read if _day(r[0]) is not None), read[0])


def _written(original: str, surrogate: str, keep) -> str:
    """The surrogate's characters in the places of the original's own (those that `keep` accepts)."""
    letters = iter(surrogate)
    out = []
    for c in original:
        if keep(c):
            s = _digit_like(next(letters), c)
            out.append(s.upper() if c.isupper() else s)
        else:
            out.append(c)
    return "".join(out)


def _one(maker: Surrogates, kind: str, text: str) -> tuple[str, list[tuple[str, str]]]:
    """The written surrogate, and (canonical original, its surrogate): for a name of each of its words."""
    if kind == "name":
        out, made_of, at = [], [], 0
        for a, b in _name_words(text):
            word = text[a:b]
            made = maker.replace("name", _lower(word))
            made_of.append((_lower(word), made))
            out += [text[at:a], made.upper() if word.isupper() and len(word) > 1 else made[:1].upper() + made[1:] if word[0].isupper() else made]
            at = b
        return "".join(out) + text[at:], made_of
    canonical = _canonical(kind, text)
    made = maker.replace(kind, canonical)
    written = made
    if kind == "birth":
        parts = {"y": made[:4], "m": made[4:6], "d": made[6:]}
        written = re.search(r"[-./]", text)[0].join(parts[x] for x in _birth_parts(text)[1])
    elif kind in ("card", "ssn", "phone"):
        digits = re.sub(r"\D", "", _ascii_digits(text))
        country = digits[: len(digits) - 10] if kind == "phone" and canonical[0] != "+" else ""
        written = _written(text, country + made.lstrip("+"), str.isdecimal)
    elif kind == "iban":
        written = _written(text, made, lambda c: c != " ")
    elif kind == "mac":
        written = _written(text, made, str.isalnum)
    elif kind in ("email", "ipv6"):
        written = _written(text, made, lambda c: True)
    elif kind == "ipv4" and not text.isascii():
        zero = next(c for c in text if c.isdecimal() and not c.isascii())
        written = "".join(_digit_like(c, zero) for c in made)
    return written, [(canonical, made)]


def redact(text: str, maker: Surrogates) -> tuple[str, list[tuple[str, int, str, str]]]:
    """The text with surrogates, and (kind, start in the original, canonical, surrogate) of each."""
    spans = find(text)
    if not spans:
        return text, []
    out, entities, at = [], [], 0
    for a, b, kind in spans:
        written, made_of = _one(maker, kind, text[a:b])
        out += [text[at:a], written]
        entities += [(kind, a, c, made) for c, made in made_of]
        at = b
    out.append(text[at:])
    return "".join(out), entities


def surrogates(df: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text", with_entities: bool = False, repairs: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """Each row's id_col, text with surrogates, n_entities and the counts of each kind; with_entities
    adds (kind, original's digest, surrogate), the originals themselves never leave the task."""
    slim = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = slim.schema[0].dataType.simpleString()
    names = [f"n_{k}" for k in KINDS]
    fields = f"`{id_col}` {kind}, text string, n_entities int, " + ", ".join(f"{n} int" for n in names)
    fields += ", entities array<struct<kind:string,original:string,surrogate:string>>" * with_entities

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(key, repairs)
        for batch in steps(batches, "_text"):
            texts, found = [], []
            for text in batch.column(1).to_pylist():
                made, entities = redact(text, maker) if text else (text, [])
                texts.append(made)
                found.append(entities)
            counts = [pa.array([sum(e[0] == k for e in x) for x in found], pa.int32()) for k in KINDS]
            arrays = [batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in found], pa.int32()), *counts]
            heads = [id_col, "text", "n_entities", *names]
            if with_entities:
                arrays.append(_entities(found, maker))
                heads.append("entities")
            yield pa.RecordBatch.from_arrays(arrays, names=heads)

    return slim.mapInArrow(run, fields)


def key_of(spark: SparkSession) -> bytes:
    """The key that the session's setting names; the example key, with a warning, where it is unset."""
    found = spark.conf.get(KEY_SETTING, None)
    if found:
        return found.encode()
    warnings.warn(f"{KEY_SETTING} is unset: surrogates are made with the published example key", stacklevel=2)
    return EXAMPLE_KEY


def _entities(found: list, maker: Surrogates) -> pa.Array:
    listed = [[{"kind": k, "original": maker.sign(c), "surrogate": w} for k, _, c, w in x] for x in found]
    return pa.array(listed, pa.list_(pa.struct([("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())])))


def collisions(found: DataFrame, column: str = "entities") -> DataFrame:
    """(kind, surrogate, originals): surrogates that more than one original of a kind got, of a table
    from surrogates(with_entities=True). None are expected."""
    one = found.select(F.explode(column).alias("e")).select("e.*")
    return one.distinct().groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("originals")).where("originals > 1")


def _without_collisions(make: Callable[[dict], DataFrame], column: str) -> DataFrame:
    """The table that make(repairs) gives, written once, with its originals' digests in `column`; made
    again, with other surrogates for all but one of the originals that share one, until none do."""
    repairs: dict[tuple[str, str], int] = {}
    while True:
        found = materialise(make(repairs), "surrogates")
        shared = collisions(found, column)
        if not shared.limit(1).count():
            return found
        one = found.select(F.explode(column).alias("e")).select("e.*").distinct()
        both = one.join(shared.drop("originals"), ["kind", "surrogate"])
        first = both.groupBy("kind", "surrogate").agg(F.min("original").alias("first"))
        moved = both.join(first, ["kind", "surrogate"]).where("original <> first").select("kind", "original")
        for r in moved.limit(MOST_REPAIRS).collect():  # of more, the rest in the next round
            repairs[r.kind, r.original] = repairs.get((r.kind, r.original), 0) + 1
        release(found)


def checked(df: DataFrame, key: bytes, **options) -> DataFrame:
    """surrogates(), after a check over the whole table that no two originals of a kind share one."""
    return _without_collisions(lambda repairs: surrogates(df, key, with_entities=True, repairs=repairs, **options), "entities").drop("entities")


def anonymise(df: DataFrame, key: bytes, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df, all columns, with surrogates in its text and the length column, if it has one, renewed,
    after the check that no two originals of a kind share one. Texts are searched once."""
    column = fresh(df, "entities")
    fields = StructType([*df.schema.fields, *StructType.fromDDL(f"{column} array<struct<kind:string,original:string,surrogate:string>>").fields])

    def make(repairs: dict) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            maker = Surrogates(key, repairs)
            for batch in steps(batches, text_col):
                at = batch.schema.get_field_index(text_col)
                made = [redact(t, maker) if t else (t, []) for t in batch.column(at).to_pylist()]
                batch = batch.set_column(at, batch.schema.field(at), pa.array([t for t, _ in made], batch.schema.field(at).type))
                yield batch.append_column(column, _entities([e for _, e in made], maker))

        return df.mapInArrow(run, fields)

    out = _without_collisions(make, column).drop(column)
    if length_col in df.columns:
        length = F.length(text_col).cast(df.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.col(length_col).isNull() | F.col(text_col).isNull(), F.col(length_col)).otherwise(length))
    return out
