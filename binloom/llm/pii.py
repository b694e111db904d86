"""Surrogates for personal data: keyed, type-consistent, distinct.

Detected entities are replaced by values of the same type and format. The replacement is a keyed permutation of all
values of that format (digits by digits, consonants by consonants, vowels by vowels, letters of other alphabets by letters of the
same script and case, punctuation as it is; given names by given names of the same gender and script), so equal entities get equal surrogates in every document
(coreference) and different ones different surrogates, without a table of entities. The permutation is a shift between
a keyed enciphering and its inverse, which leaves no value as it is. What only writes a value differently (blanks in an
account number, separators of a phone number, case of an address, the script of digits) is set aside before and applied again after, so
one entity in several formats keeps one surrogate. Check digits are renewed; a phone's country, a card's first digit and a secret's known prefix stay.

The key comes from the session's ``spark.binloom.surrogates.key``. Without one each call draws a key and forgets it, so
surrogates are consistent within a run and can't be undone afterwards.

Names are found after given names of a list, after titles and after phrases that announce a name; other names aren't.
Two checks follow. In each document, a surrogate that another
entity has or that the text holds elsewhere (as a word or words, of any length) is a collision: the next value of the
permutation is taken, in order of first mention, so such a document differs from others in that entity; only where
``RETRIES`` values or the whole cycle are in use does the first one stand, counted in ``n_collisions``. ``collisions``
looks for two originals with one surrogate over a whole corpus.

Odd cases: a null text stays null and has no entities; an empty one stays empty. Repeated rows and ids give equal rows.
A null ``doc_id`` stays null. No rows in, no rows out. ``report`` ignores other columns, ``replace`` keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import INT, LONG, STR, own_columns, schema

KEY_SETTING = "spark.binloom.surrogates.key"
#: Values of a permutation that are tried for an entity of a document.
RETRIES = 64

#: Given names by script and gender.
NAMES = {
    ("latin", "f"): "Anna Maria Emma Laura Julia Sarah Sofia Elena Clara Marie Alice Lucia Carmen Helena Ingrid Monika Claudia Susanne Camille Chloe Margot Isabel Beatriz Paula Emily Olivia Hannah Rachel Jessica Linda Patricia Jennifer Elizabeth Susan Karen Nancy Mary Barbara Margaret Dorothy".split(),
    ("latin", "m"): "John James Robert Michael William David Richard Joseph Thomas Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Brian Edward Peter Hans Klaus Stefan Juergen Wolfgang Pierre Jean Luc Antoine Julien Carlos Juan Miguel Javier Pablo Diego Fernando Andreas Martin".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Андрей Николай Владимир Михаил Павел Олег".split(),
    ("greek", "f"): "Ελένη Μαρία Κατερίνα Σοφία Αγγελική Ιωάννα".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Παναγιώτης Χρήστος".split(),
}
_GENDER = {name: kind for kind, names in NAMES.items() for name in names}
#: Letters that stand for each other.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуэюя", "бвгджзклмнпрстфхцчш", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
_CLASS = {c: letters for letters in CLASSES for c in letters}


@lru_cache(64)
def _script(script: str, category: str, low: int, high: int) -> str:
    """Letters of a script and case in a range; of those with classes only the others."""
    found = [c for c in map(chr, range(low, high)) if c not in _CLASS and unicodedata.category(c) == category and unicodedata.name(c, "").split("-")[0].split(" ")[0] == script]
    return "".join(c for c in found if unicodedata.normalize("NFKC", c) == c)  # no letters that stand for others


@lru_cache(1 << 12)
def _letters(c: str) -> str | None:
    """The letters that may stand for ``c``; None if it isn't a letter or digit."""
    if c in _CLASS or c.isascii():
        return _CLASS.get(c)
    category = unicodedata.category(c)
    if category not in ("Lu", "Ll", "Lo"):
        return None
    common = "\xc0" <= c < "\u0180"  # accented Latin letters of European languages are kept among themselves
    letters = _script(unicodedata.name(c, "").split("-")[0].split(" ")[0], category, *((0xC0, 0x180) if common else (128, 0x10000)))
    return letters if c in letters else None


HEX_LOW, HEX_UP = "0123456789abcdef", "0123456789ABCDEF"


def _cipher(key: bytes, tweak: bytes, n: int) -> tuple[Callable[[int], int], Callable[[int], int]]:
    """A keyed permutation of range(n) and its inverse: Feistel rounds over the next even number of bits, walked until in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, half // 8 + 8

    def f(i: int, x: int) -> int:
        seed = hashlib.blake2b(x.to_bytes(half // 8 + 1, "big") + bytes([i]) + tweak, key=key, digest_size=32).digest()
        return int.from_bytes(hashlib.shake_128(seed).digest(size), "big") & mask

    def there(x: int) -> int:
        while True:
            a, b = x >> half, x & mask
            for i in range(8):
                a, b = b, a ^ f(i, b)
            if (x := a << half | b) < n:
                return x

    def back(x: int) -> int:
        while True:
            a, b = x >> half, x & mask
            for i in reversed(range(8)):
                a, b = b ^ f(i, a), a
            if (x := a << half | b) < n:
                return x

    return there, back


def permute(value: str, alphabets: list[str | None], key: bytes, what: str) -> str:
    """Another string over the same alphabet at each place (None: the character stays); a permutation of all such strings without a fixed one."""
    n, x = 1, 0
    for c, letters in zip(value, alphabets):
        if letters:
            n, x = n * len(letters), x * len(letters) + letters.index(c)
    if n == 1:
        return value
    pattern = "".join(letters[0] if letters else c for c, letters in zip(value, alphabets))
    there, back = _cipher(key, f"{what}\0{pattern}".encode(), n)
    y, out = back((there(x) + 1) % n), []
    for c, letters in zip(reversed(value), reversed(alphabets)):
        if letters:
            y, i = divmod(y, len(letters))
            c = letters[i]
        out.append(c)
    return "".join(reversed(out))


#: Places that are permuted together; longer values are permuted in parts, each under all that stands before it.
_PART = 128


def _by_class(value: str, key: bytes, what: str, alphabets: list[str | None] | None = None) -> str:
    alphabets = alphabets or [_letters(c) for c in value]
    if len(value) <= _PART:
        return permute(value, alphabets, key, what)
    out, before = [], hashlib.sha256(key)
    for at in range(0, len(value), _PART):
        out.append(permute(value[at : at + _PART], alphabets[at : at + _PART], key, f"{what}{before.hexdigest()}"))
        before.update(value[at : at + _PART].encode())
    return "".join(out)


def _cased(value: str, make: Callable[[str], str]) -> str:
    """``make`` of the value in lower case, with the case of the value."""
    low = value.lower()
    if len(low) != len(value):  # a letter whose lower case is two
        return make(value)
    return "".join(n.upper() if c != x and len(n.upper()) == 1 else n for c, x, n in zip(value, low, make(low)))


def _plain(value: str) -> str:
    """Decimal digits of any script as ASCII digits."""
    return value if value.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in value)


def _as_written(make: Callable[[str, bytes], str]) -> Callable[[str, bytes], str]:
    """``make`` for values in digits of any script: the same number in two scripts gets one surrogate, its digits written as the original's."""

    def run(value: str, key: bytes) -> str:
        new = make(_plain(value), key)
        if value.isascii():
            return new
        zeros = [ord(c) - unicodedata.decimal(c) for c in value if c.isdecimal()]
        out, k = [], 0
        for c in new:
            if c.isdecimal():
                c, k = chr(zeros[min(k, len(zeros) - 1)] + int(c)), k + 1  # only an address can get more digits
            out.append(c)
        return "".join(out)

    return run


def _luhn(digits: str) -> int:
    """Check digit after ``digits``."""
    return -sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _card(value: str, key: bytes) -> str:
    """First digit, grouping and the distance of the last digit from the right check digit stay."""
    at = [i for i, c in enumerate(value) if c.isdigit()]
    digits = "".join(value[i] for i in at)
    gap = (int(digits[-1]) - _luhn(digits[:-1])) % 10
    new = permute(digits[:-1], [None, *["0123456789"] * (len(digits) - 2)], key, "card")
    new += str((_luhn(new) + gap) % 10)
    out = list(value)
    for i, c in zip(at, new):
        out[i] = c
    return "".join(out)


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _iban(value: str, key: bytes) -> str:
    plain = value.replace(" ", "")
    new = permute(plain, [None if i < 4 else "0123456789" if c.isdigit() else _UP if c.isupper() else None for i, c in enumerate(plain)], key, "iban")
    check = 98 - int("".join(str(int(c, 36)) for c in new[4:] + plain[:2]) + "00") % 97
    digits = iter(f"{plain[:2]}{check:02d}{new[4:]}")
    return "".join(c if c == " " else next(digits) for c in value)


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _ip(value: str, key: bytes) -> str:
    n = int.from_bytes(bytes(map(int, value.split("."))), "big")
    there, back = _cipher(key, b"ip", 1 << 32)
    return ".".join(map(str, back((there(n) + 1) % (1 << 32)).to_bytes(4, "big")))


def _email(value: str, key: bytes) -> str:
    user, _, host = value.rpartition("@")
    labels, _, top = host.rpartition(".")
    return f"{_cased(user, lambda v: _by_class(v, key, 'user'))}@{_cased(labels, lambda v: _by_class(v, key, 'host'))}.{top}"


#: Country numbers of one and two digits; all others have three.
COUNTRIES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def _phone(value: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", value)
    n = next((k for k in (1, 2) if digits[:k] in COUNTRIES), 3) if value.startswith("+") else 0  # the country's number stays
    new = iter(digits[:n] + permute(digits[n:], ["0123456789"] * (len(digits) - n), key, "phone"))
    return "".join(next(new) if c.isdigit() else c for c in value)


def _mac(value: str, key: bytes) -> str:
    plain = re.sub("[:-]", "", value)
    new = iter(_cased(plain, lambda v: permute(v, [HEX_LOW] * len(v), key, "mac")))
    made = "".join(c if c in ":-" else next(new) for c in value)
    return made.upper() if value == value.upper() else made.lower() if value == value.lower() else made


_PREFIX = re.compile(r"AKIA|gh[pousr]_|sk-|")


def _secret(value: str, key: bytes) -> str:
    letters = HEX_LOW if set(value) <= set(HEX_LOW) else HEX_UP if set(value) <= set(HEX_UP) else None
    n = _PREFIX.match(value).end()
    return _by_class(value, key, "hex", [letters] * len(value)) if letters else value[:n] + _by_class(value[n:], key, f"secret{value[:n]}")


def _given(value: str, key: bytes) -> str:
    names = NAMES[_GENDER[value]]
    there, back = _cipher(key, repr(_GENDER[value]).encode(), len(names))
    return names[back((there(names.index(value)) + 1) % len(names))]


def _plausible(kind: str, m: re.Match) -> bool:
    v = _plain(m[0])
    if kind == "ip":
        return all(int(x) < 256 and str(int(x)) == x for x in v.split("."))
    if kind == "iban":
        return _iban_ok(v)
    if kind == "card":  # other long numbers aren't payment cards
        digits = re.sub(r"\D", "", v)
        return _luhn(digits[:-1]) == int(digits[-1])
    return True


#: Type, what a text must hold for it to be searched, pattern, surrogate. Earlier types win where two overlap.
TYPES: list[tuple[str, str | None, re.Pattern, Callable[[str, bytes], str]]] = [
    ("email", "@", re.compile(r"(?<![\w.+-])[^\W_][\w.+%-]{0,63}@(?:[^\W_][\w-]{0,62}\.){1,126}[^\W\d_]{2,63}(?![\w@])"), _email),
    ("secret", None, re.compile(r"""(?i:(?<![A-Za-z])(?:token|secret|api[_-]?key|password|passwd|pwd|access[_-]?key)["']?\s*[=:]\s*["']?)([A-Za-z0-9+/_.~!@#$%^&*-]{6,}={0,2})"""), _secret),
    ("secret", None, re.compile(r"(?<![A-Za-z0-9])(?=[a-z]*[0-9])(?=[0-9]*[a-z])[0-9a-f]{32,}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[0-9A-F]{32,}(?![A-Za-z0-9])|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})\b"), _secret),
    ("ip", ".", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"), _as_written(_ip)),
    ("iban", None, re.compile(r"(?<![A-Za-z\d])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![A-Za-z\d])"), _as_written(_iban)),
    ("card", None, re.compile(r"(?<![\d.])(?:\d{4}[ -]){3}\d{4}(?:[ -]?\d{1,3})?(?![\d])|(?<![\d.])\d{13,19}(?!\d)"), _as_written(_card)),
    ("ssn", "-", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), _as_written(lambda v, k: permute(v, ["0123456789" if c.isdigit() else None for c in v], k, "ssn"))),
    ("phone", None, re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"), _as_written(_phone)),
    ("mac", None, re.compile(r"(?<![0-9A-Fa-f:-])(?:(?:[0-9A-Fa-f]{2}:){5}|(?:[0-9A-Fa-f]{2}-){5})[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])"), _mac),
]
#: Only the first word is consumed, so the next one may be a given name itself.
_NAMED = re.compile(r"(?<!\w)([A-ZА-ЯΑ-Ω][^\W\d_]+)(?= ((?:(?:van|von|de|da|di|del) )?[^\W\d_][^\W\d_]+(?:-[^\W\d_]+)?)\b)")
#: What announces a person's name, and the words of the name: capitalised, or of a script without case.
_TITLE = r"Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Srta|Doña|г-н|г-жа|господин|госпожа|κύριος|κυρία"
_PHRASE = r"[Mm]y name is|[Nn]ame is|[Ff]ull [Nn]ame:|[Nn]ame:|[Ss]igned(?: by)?[,:]?|[Ss]incerely,|[Rr]egards,|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут|[Μμ]ε λένε|姓名[:：]|我叫"
_CALLED = re.compile(rf"(?<!\w)(?:(?:{_TITLE})\.? |(?:{_PHRASE})\s*)(?:(?:{_TITLE})\.? )?(?=((?:[^\W\d_]+(?:[-'’][^\W\d_]+)*\.?)(?: (?:(?:van|von|de|da|di|del|bin|al) )?[^\W\d_]+(?:[-'’][^\W\d_]+)*){{0,3}}))")
_PARTICLES = {"van", "von", "de", "da", "di", "del", "bin", "al"}
#: Types that need a digit; most texts have none.
_DIGITS = {"ip", "iban", "card", "ssn", "phone", "mac"}
_DIGIT, _WORDS = re.compile(r"\d"), ("token", "secret", "key", "passw", "pwd", "akia")


def _may_hold_secret(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in _WORDS) or ("_" in text and "gh" in low) or "sk-" in text or max(map(len, text.split()), default=0) >= 32


def _called(m: re.Match) -> list[tuple[int, str]]:
    """Place and word of each part of an announced name."""
    out = []
    for w in re.finditer(r"[^ ]+", m[1]):
        if w[0] in _PARTICLES:
            continue
        word = w[0].rstrip(".")
        if not (word[0].isupper() or unicodedata.category(word[0]) == "Lo"):
            break
        if len(word) > 1 or unicodedata.category(word[0]) == "Lo":  # not an initial
            out.append((m.start(1) + w.start(), word))
    return out


def detect(text: str) -> list[tuple[int, int, str]]:
    """[from, to) and type of each entity, in order, none overlapping."""
    found: list[tuple[int, int, str]] = []  # in order

    def add(a: int, z: int, kind: str) -> bool:
        k = bisect_left(found, (z,))  # of what begins before the end, the last ends last
        if k and found[k - 1][1] > a:
            return False
        insort(found, (a, z, kind))
        return True

    digit, wordy = bool(_DIGIT.search(text)), _may_hold_secret(text)
    for kind, needs, pattern, _ in TYPES:
        if (needs and needs not in text) or (kind in _DIGITS and not digit) or (kind == "secret" and not wordy):
            continue
        for m in pattern.finditer(text):
            if _plausible(kind, m):
                add(*m.span(m.lastindex or 0), kind)
    full = [m for m in _NAMED.finditer(text) if m[1] in _GENDER and m[2].split(" ")[-1][0].isupper()]
    called = [c for c in map(_called, _CALLED.finditer(text)) if c]
    if full or called:  # a person's given name or surname by itself is the same person
        given, at = {m[1] for m in full} | {c[0][1] for c in called if len(c) > 1}, {m.start() for m in full} | {c[0][0] for c in called if len(c) > 1}
        last = {m.end(2) - len(m[2].split(" ")[-1]): m[2].split(" ")[-1] for m in full} | {c[-1][0]: c[-1][1] for c in called}
        last = {i: w for i, w in last.items() if i not in at}  # of several given names only the last has the surname after it
        other = {w for c in called for _, w in c[1:-1]}
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(given | other | set(last.values()), key=lambda s: (-len(s), s)))) + r")(?!\w)", text):
            add(*m.span(), ("given" if m[0] in _GENDER else "name") if m[0] in given and m.start() not in last else "surname")
    return found


_MAKE = {kind: make for kind, _, _, make in TYPES} | {"given": _given, "name": lambda v, k: _by_class(v, k, "name"), "surname": lambda v, k: _by_class(v, k, "surname")}


@lru_cache(1 << 14)
def surrogate(kind: str, value: str, key: bytes) -> str:
    return _MAKE[kind](value, hashlib.sha256(key).digest())


_RUN = re.compile(r"\w+")


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]], int]:
    """The text with surrogates; (type, original, surrogate) of each entity; collisions."""
    found = detect(text)
    if not found:
        return text, [], 0
    ends = [0, *(z for _, z, _ in found)]
    rest = [text[a:z] for a, z in zip(ends, [*(a for a, _, _ in found), len(text)])]
    left, chosen, taken, bad = "\0".join(rest), {}, set(), 0
    words = set(_RUN.findall(left))  # what stands there holds whole words of the text only
    free = lambda new: new not in taken and not (words.issuperset(_RUN.findall(new)) and new in left and re.search(rf"(?<!\w){re.escape(new)}(?!\w)", left))
    for a, z, kind in found:
        if (kind, text[a:z]) in chosen:
            continue
        new = first = surrogate(kind, text[a:z], key)
        for _ in range(RETRIES):
            if new == text[a:z] or free(new):
                break
            new = surrogate(kind, new, key)
        if new == text[a:z] or not free(new):  # the permutation's cycle has no free value
            new, bad = first, bad + 1
        chosen[kind, text[a:z]] = new
        taken.add(new)
    made = [(kind, text[a:z], chosen[kind, text[a:z]]) for a, z, kind in found]
    return "".join(x for r, (_, _, new) in zip(rest, made) for x in (r, new)) + rest[-1], made, bad


def _column(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, kinds, bad = [], [], [], []
            for t in b.column("text").to_pylist():
                new, made, hits = replaced(t, key) if t else (t, [], 0)
                texts.append(new)
                n.append(len(made))
                kinds.append(len({m[:2] for m in made}))
                bad.append(hits)
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32()), pa.array(kinds, pa.int32()), pa.array(bad, pa.int32())], [*b.schema.names, "n_entities", "n_distinct", "n_collisions"])

    return run


def configured_key(spark: SparkSession) -> bytes:
    """The session's key, or a fresh one."""
    found = spark.conf.get(KEY_SETTING, None)
    return found.encode() if found else secrets.token_bytes(32)


def report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, text with surrogates, n_entities, n_distinct, n_collisions of each row of ``docs``."""
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_column(key or configured_key(docs.sparkSession)), schema(doc_id=LONG, text=STR, n_entities=INT, n_distinct=INT, n_collisions=INT))


def replace(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; other columns as they are, but ``n_chars``, where it is there, follows the text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string"))
    kind = schema(row=rows.schema["row"].dataType, text=STR, n_entities=INT, n_distinct=INT, n_collisions=INT)
    out = rows.mapInArrow(_column(key or configured_key(docs.sparkSession)), kind)
    length = lambda c: F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType)
    return out.select(*[F.col("text") if c == "text" else length(c).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def collisions(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """type, surrogate, n of the surrogates that stand for more than one original, over all of ``docs``; only values taken after a document's own collision can."""
    key = key or configured_key(docs.sparkSession)

    def run(batches):
        for b in batches:
            made = [m for t in b.column("text").to_pylist() if t for m in replaced(t, key)[1]]
            yield pa.RecordBatch.from_pylist([{"kind": k, "original": o, "surrogate": s} for k, o, s in made], pa.schema([("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())]))

    made = docs.select(F.col("text").cast("string")).mapInArrow(run, schema(kind=STR, original=STR, surrogate=STR)).distinct()
    return made.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
