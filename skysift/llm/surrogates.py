"""Personal data replaced by surrogates.

Detected entities are brought to a canonical form (letters' case and punctuation aside), so that all mentions of one
entity, in any document and format, get one replacement. The replacement follows from a secret key: digits become
digits, letters letters of their script and case, cards keep their check digit, addresses stay addresses, names keep
their gender and script, and every mention keeps its case. Names are found after a title (see PATTERNS), where a given name of GIVEN stands before
another capitalised word, or where the words beside two or three capitalised ones say that they are a person (CUES); not where the last
of them, or the next, is a word for a place or a body (PLACES). Where a document has such a name, its other whole-word mentions of the
name or of parts of it are replaced too. Distinct entities must stay distinct: replacements that meet, or that are themselves entities of the corpus, are
drawn again for all but one of them until none meet; from the fourth draw on they grow longer, so that no space is ever full.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import os
import re
import unicodedata
from bisect import bisect, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.shared import by_row, row_tag, stored, table

#: The setting that holds the key of the query's surrogates; where it is unset, a key is drawn for the run.
KEY_SETTING = "spark.skysift.surrogates.key"
UPPER = "A-ZÀ-ÖØ-ÞЀ-ЯΑ-Ω"
NAME = rf"(?:[{UPPER}]['’](?=[{UPPER}]))?[{UPPER}][^\W\d_]+(?:[-'’][{UPPER}]?[^\W\d_]+)*(?!\w)"
DIGITS, NEAR = re.compile("[0-9]+"), 64
#: kind, of which strings the text must hold one (None: a digit within NEAR characters), pattern; earlier ones win where they overlap. Group 1, if there is one, is the entity.
PATTERNS = [
    ("email", ("@",), r"(?<![\w.+-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.)+[^\W\d_]{2,24}(?![\w-])"),
    ("key", ("AKIA",), r"\b(AKIA[0-9A-Z]{16})\b"),
    ("key", ("gh", "sk_", "xox"), r"\b(gh[pousr]_[A-Za-z0-9]{36,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("secret", ("password", "passwd", "pwd", "secret", "token", "api", "access", "auth"), r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth))[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_.~-]{6,}={0,2})"),
    ("secret", ("password", "passwd", "passwort", "contraseña"), r"(?i:\b(?:password|passwd|passwort|contraseña)\s+(?:is|was|ist|es)\s+)[\"']?((?=[^\s\"']*[0-9])[A-Za-z0-9+/_.~!#$%&*-]{6,}(?<![.!]))"),
    ("document", None, r"(?i:\b(?:passport|reisepass|passeport|pasaporte)(?:\s*(?:no|nr|number|nummer|numéro|número|n°|#))?\.?\s*(?:is|ist|est|es|:|=)?\s*)([A-Z]{0,2}[0-9]{6,9})(?![\w-])"),
    ("date", None, r"(?i:\b(?:born(?:\s+on)?|date\s+of\s+birth|dob|geboren(?:\s+am)?|geburtsdatum|née?\s+le|nacid[oa]\s+el)\s*[:=]?\s*)([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![\w-])"),
    ("iban", None, r"\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"),
    ("ipv4", None, r"(?<![\w.])((?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?!\.?\w)"),
    ("ipv6", None, r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])((?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])"),
    ("ssn", None, r"(?<![\w-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"),
    ("card", None, r"(?<![\w-])([0-9](?:[ -]?[0-9]){12,18})(?![\w-])"),
    ("phone", None, r"(?<![\w.+-])(\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{1,5}(?:[ .-]?[0-9]{2,5}){1,4}|\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,5}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![\w-])"),
    ("man", ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Signor"), rf"\b(?:Mr|Mister|Herr|Monsieur|Señor|Sr|Signor)\b\.? ({NAME}(?: {NAME}){{0,2}})"),
    ("woman", ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora"), rf"\b(?:Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Signora)\b\.? ({NAME}(?: {NAME}){{0,2}})"),
    ("person", ("Dr", "Prof", "Doctor", "Doktor"), rf"\b(?:Dr|Prof|Professor|Doctor|Doktor)\b\.?(?: (?:Dr|Prof)\b\.?)* ({NAME}(?: {NAME}){{0,2}})"),
]
COMPILED = [(k, hold, re.compile(p)) for k, hold, p in PATTERNS]
#: First names of a gender and script.
FIRST = {
    ("man", "LATIN"): "Adam Albert Bruno Carl Daniel David Emil Felix Gabriel Hugo Jonas Julian Leo Lucas Marc Martin Max Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("woman", "LATIN"): "Alice Anna Bella Clara Diana Elena Emma Eva Helena Ines Irene Julia Laura Lea Lucia Maria Marta Nina Nora Olivia Paula Rosa Sara Vera".split(),
    ("person", "LATIN"): "Alex Charlie Dana Jules Kai Kim Luca Noel Robin Sam Sasha Toni".split(),
    ("person", "CYRILLIC"): "Валя Женя Саша Шура".split(),
    ("man", "CYRILLIC"): "Алексей Андрей Борис Виктор Денис Иван Игорь Максим Николай Олег Павел Сергей".split(),
    ("woman", "CYRILLIC"): "Алина Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Полина Татьяна".split(),
}
#: Given names that show a name without a title: those above and other common ones.
GIVEN = {
    n: kind
    for kind, names in {
        "man": "Alexander Andrew Anton Antonio Arthur Ben Benjamin Carlos Charles Christian Christopher Edward Eric Francisco François Frank Fritz Georg George Hans Harry Heinrich Henry Jack Jacob Jakob James Jean Joe John José Joseph Juan Karl Klaus Louis Luis Manuel Matthew Michael Miguel Otto Patrick Pedro Peter Philip Pierre Richard Stefan Steven Tom Walter William",
        "woman": "Alexandra Amelia Amy Angela Ann Anne Barbara Camille Carla Caroline Catherine Charlotte Christine Claire Claudia Elizabeth Elisabeth Emily Eleanor Esther Eve Grace Greta Hannah Heidi Helen Ingrid Isabel Jane Jennifer Jessica Joan Karen Katharina Linda Lisa Lucy Margaret Marie Mary Monika Pilar Rachel Ruth Sandra Sarah Sofia Sophie Susan Teresa Ursula Victoria",
    }.items()
    for n in names.split()
} | {n: kind for (kind, _), names in FIRST.items() for n in names}
#: What says that the capitalised words after or before it are a person.
BEFORE = r"(?i:my name is|i am called|full name|signed by|signed|kind regards|best regards|regards|sincerely|yours truly|dear|attn|contact person|mein name ist|unterzeichnet von|mit freundlichen grüßen|je m'appelle|me llamo)"
AFTER = r"(?:said|says|wrote|writes|told|tells|asked|asks|replied|replies|answered|lives (?:at|in)|was born|is \d+ years old|sagte|schrieb|wohnt in|wurde geboren|dit|écrit|habite|dijo|escribió|vive en)\b"
TWO = rf"{NAME}(?: {NAME}){{1,2}}"
CUES = [(("name", "igned", "egards", "incerely", "ruly", "ear ", "ttn", "ontact", "unterzeichnet", "Grüßen", "appelle", "llamo"), re.compile(rf"\b{BEFORE}[:,]?\s+({TWO})")), (None, re.compile(rf"(?<![\w.'’-])({TWO})(?= {AFTER}|,? (?:aged )?\d\d?,| <[\w.+-]+@)"))]
#: Words for places and bodies: what ends in one, or stands before one, is none's name.
PLACES = frozenset("Station Street Road Avenue Lane Square Park Garden Gardens Institute University College School Academy Airport Hospital Bridge Tower Prize Award Museum Library Lake River Mountain Mount Falls Island Islands County City Bay Beach Church Cathedral Palace Castle Hall House Center Centre Foundation Society Company Corporation Inc Ltd GmbH AG Corp Group Bank Club Court Theatre Theater Hotel Stadium Street Straße Platz Allee Institut Universität Discussion Stiftung Verlag Rue Place Calle Plaza Avenida".split())
#: Words that begin a capitalised pair which is no person.
OPENERS = frozenset("The A An This That These Those Our My Your His Her Their Its No Every Each New Old Great North South East West San Santa Los Las Saint St In On At By For From With And But Or As If When While After Before Then Der Die Das Ein Eine Le La Les Un Une El Una".split())
UNTITLED = re.compile(rf"(?<![\w-])({NAME})(?= ({NAME}(?: {NAME})?))")
SYLLABLES = {"LATIN": "ba be bo da do fa fe ga go ha ka ke ko la le lo ma me mo na ne no pa po ra re ro sa se ta te to va ve vo".split(), "CYRILLIC": "ба бе бо да до га го ка ко ла ле ло ма ме мо на не но па по ра ре ро са се та те то ва ве во".split()}

GENDERS = ("man", "woman", "person")
NAMES = (*GENDERS, "surname")

Mention = tuple[int, int, str, list[tuple[str, str]]]  # start, end, kind, entities (see canon)


def luhn(digits: str) -> int:
    """0 if the last digit is the check digit of the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def draw(key: bytes, kind: str, canonical: str, attempt: int) -> Callable[[int], int]:
    """Numbers below n, one after the other, that only the key's owner can foresee."""
    state = {"block": b"", "n": 0}
    seed = f"{kind}\x00{canonical}\x00{attempt}".encode()

    def below(n: int) -> int:
        if len(state["block"]) < 4:
            state["block"] += hmac.new(key, seed + state["n"].to_bytes(4, "big"), hashlib.sha256).digest()
            state["n"] += 1
        x, state["block"] = int.from_bytes(state["block"][:4], "big"), state["block"][4:]
        return x % n

    return below


def script_of(c: str) -> str:
    return unicodedata.name(c, "LATIN").split(" ")[0]


def like(c: str, below: Callable[[int], int], hexadecimal: bool = False) -> str:
    """Another character of c's class: digit, letter of its script and case; anything else stays."""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return chr(zero + below(10))
    if "a" <= c <= "z":
        return chr(97 + below(6 if hexadecimal else 26))
    if "A" <= c <= "Z":
        return chr(65 + below(6 if hexadecimal else 26))
    if c.isalpha():
        near = [x for x in map(chr, range(max(ord(c) - 24, 0xAA), ord(c) + 25)) if x.isalpha() and unicodedata.category(x) == unicodedata.category(c) and script_of(x) == script_of(c)]
        return near[below(len(near))] if near else c
    return c


def canon(kind: str, value: str) -> list[tuple[str, str]]:
    """The entities in one mention, as (kind, canonical form): a name has one for each part, a mail address one for its domain."""
    if kind == "email":
        local, _, domain = value.lower().rpartition("@")
        return [("email", f"{local}@{domain}"), ("domain", domain)]
    if kind in ("card", "phone", "ssn"):
        digits = re.sub(r"[^0-9]", "", value)
        # with or without its country's code a number of North America is one
        return [(kind, digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits)]
    if kind == "date":
        return [(kind, "{:04}-{:02}-{:02}".format(*date_parts(value)))]
    if kind == "iban":
        return [(kind, value.replace(" ", ""))]
    if kind == "ipv6":
        try:
            return [(kind, ipaddress.IPv6Address(value).compressed)]
        except ValueError:
            return [(kind, value.lower())]
    if kind in GENDERS:
        parts = value.split(" ")
        return [(GIVEN.get(p.capitalize(), kind) if kind == "person" else kind, folded(p)) for p in parts[:-1]] + [("surname", folded(parts[-1]))]
    return [(kind, value)]


def folded(name: str) -> str:
    """A part of a name, case and sort of apostrophe aside."""
    return name.lower().replace("’", "'")


def date_parts(value: str) -> tuple[int, int, int]:
    """Year, month and day; of two numbers that could both be the month the first is, after slashes, else the second."""
    a, b, c = (int(x) for x in re.split(r"[./-]", value))
    if a > 31:
        return a, b, c
    return (c, a, b) if a <= 12 and ("/" in value or b > 12) else (c, b, a)


def dated(value: str, iso: str) -> str:
    """iso in value's format."""
    year, month, day = iso.split("-")
    parts = re.split(r"([./-])", value)
    y, m, d = date_parts(value)
    first = parts[0] == "%d" % y or len(parts[0]) == 4
    order = [year, month, day] if first else [month, day, year] if (int(parts[0]), int(parts[2])) == (m, d) and ("/" in value or d > 12) else [day, month, year]
    return "".join(x if i % 2 else order[i // 2].lstrip("0") if len(x) == 1 and order[i // 2][0] == "0" else order[i // 2] for i, x in enumerate(parts))


def cased(value: str, bare: str) -> str:
    """bare, in lower case, in the case of value, a part of a name."""
    if value.isupper() and len(value) > 1:
        return bare.upper()
    return bare if value.islower() else "-".join(x[:1].upper() + x[1:] for x in bare.split("-"))


def surrogate(key: bytes, kind: str, c: str, attempt: int) -> str:
    """The replacement of a canonical form, itself canonical."""
    below = draw(key, kind, c, attempt)
    longer = attempt // 4  # of forms that may have any length
    digits = lambda n: "".join(str(below(10)) for _ in range(n))
    letters = lambda n: "".join(like("a", below) for _ in range(n))
    fixed = max(attempt // 4 - 15, 0)  # of forms of a fixed length, where no draw is free
    if kind == "email":
        local, _, domain = c.rpartition("@")
        return "".join(like(x, below) for x in local) + letters(longer) + "@" + domain
    if kind == "domain":
        labels = c.split(".")
        return ".".join([*("".join(like(x, below) for x in y) + letters(longer if not i else 0) for i, y in enumerate(labels[:-1])), labels[-1]])
    if kind == "ipv4":
        return ".".join(str(1 + below(254)) for _ in range(4 + fixed))
    if kind == "ipv6":
        return "".join("0123456789abcdef"[1 + below(15)] if x.isalnum() else x for x in c) + letters(fixed)
    if kind == "card":
        body = c[0] + "".join(like(x, below) for x in c[1:-1]) + digits(fixed)
        if luhn(c):
            return body + like(c[-1], below)
        return next(body + str(d) for d in range(10) if not luhn(body + str(d)))
    if kind == "phone":
        keep = 1 if len(c) > 10 else 0
        return c[:keep] + "".join(like(x, below) for x in c[keep:]) + digits(fixed)
    if kind in ("ssn", "document"):
        return "".join(like(x, below) for x in c) + digits(fixed)
    if kind == "date":
        year = int(c[:4]) - 4 - attempt + below(9 + 2 * attempt)
        return f"{max(year, 1):04}-{1 + below(12):02}-{1 + below(28):02}"
    if kind == "iban":
        return c[:2] + "".join(like(x, below) for x in c[2:]) + digits(fixed)
    if kind == "key":
        keep = 4 if c.startswith("AKIA") else c.find("_") + 1
        return c[:keep] + "".join(like(x, below) for x in c[keep:]) + "".join(like("A", below) for _ in range(longer))
    if kind == "secret":
        hexadecimal = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", c))
        return "".join(like(x, below, hexadecimal) for x in c) + digits(longer)
    script = script_of(c[0])
    syllables = lambda n: "".join(SYLLABLES[script][below(len(SYLLABLES[script]))] for _ in range(n))
    if kind in GENDERS and (kind, script) in FIRST:
        names = FIRST[kind, script]
        return names[below(len(names))].lower() + ("" if not attempt else "-" + syllables(2 + below(2) + attempt // 4))
    if kind == "surname" and script in SYLLABLES:
        return syllables(3 + below(2) + attempt // 4)
    return "".join(like(x, below) for x in (c + c[-1] * (attempt // 4) if kind in NAMES else c))


def dress(value: str, bare: str) -> str:
    """bare in value's format: its digits and letters take the places of value's, with value's case and signs."""
    chars = iter(bare)
    return "".join(next(chars, "") if x.isalnum() else x for x in value) + "".join(chars)


def untitled(text: str, titled: list[tuple[int, int, str]], gaps: list[tuple[int, int]]) -> list[Mention]:
    """Whole-word mentions within gaps, without a title, of the names that have one in titled, and of their parts."""
    whole: dict[str, Mention] = {}
    given: dict[str, tuple[str, str]] = {}
    last: dict[str, tuple[str, str]] = {}
    for s, e, kind in titled:
        parts = canon(kind, text[s:e])
        whole.setdefault(folded(text[s:e]), (0, 0, kind, parts))
        last.setdefault(parts[-1][1], (kind, parts[-1][0]))
        for k, p in parts[:-1]:
            given.setdefault(p, (kind, k))
    forms = {x for p in {*given, *last} for x in (cased("Xx", p), p.upper(), "'".join(y[:1].upper() + y[1:] for y in cased("Xx", p).split("'")))} | {w for s, e, _ in titled for w in text[s:e].split(" ")}
    word = "|".join(map(re.escape, sorted(forms | {x.replace("'", "’") for x in forms}, key=lambda x: (-len(x), x))))
    out = []
    pattern = re.compile(rf"(?<!\w)(?:{word})(?!\w)(?: (?:{word})(?!\w))*")
    for m in (m for s, e in gaps for m in pattern.finditer(text, s, e)):
        if folded(m[0]) in whole:
            out.append((*m.span(), *whole[folded(m[0])][2:]))
            continue
        words = folded(m[0]).split(" ")
        roles = [(last.get(w) if i == len(words) - 1 else None) or given.get(w) or last[w] for i, w in enumerate(words)]
        out.append((*m.span(), roles[0][0], [(k, w) for (_, k), w in zip(roles, words, strict=True)]))
    return out


NEXT_WORD = re.compile(r" ([^\W\d_]+)")


def placed(text: str, s: int, e: int) -> bool:
    """Whether what stands there, or the word after it, is a place's or a body's name."""
    after = NEXT_WORD.match(text, e)
    return not PLACES.isdisjoint(text[s:e].split(" ")[1:]) or bool(after) and after[1] in PLACES


def mentions(text: str) -> list[Mention]:
    """(start, end, kind, entities) of what is found, in order and without overlaps."""
    found: list[tuple[int, int, str]] = []
    near: list[list[int]] = []
    for m in DIGITS.finditer(text):
        if near and m.start() - NEAR <= near[-1][1]:
            near[-1][1] = m.end() + NEAR
        else:
            near.append([max(m.start() - NEAR, 0), m.end() + NEAR])
    low = text.lower()
    for kind, hold, pattern in COMPILED:
        group = 1 if pattern.groups else 0
        if hold is None:
            found += [(*m.span(group), kind) for s, e in near for m in pattern.finditer(text, s, e)]
        elif any(x in (low if kind == "secret" else text) for x in hold):
            found += [(*m.span(group), kind) for m in pattern.finditer(text)]
    rank = {k: i for i, (k, _, _) in reversed(list(enumerate(PATTERNS)))}
    ranked = [(rank[kind], s, e, kind) for s, e, kind in found]
    ranked += [(len(PATTERNS), m.start(1), m.end(2), GIVEN[m[1].capitalize()]) for m in UNTITLED.finditer(text) if m[1].capitalize() in GIVEN and not placed(text, m.start(1), m.end(2))]
    for hold, pattern in CUES:
        if hold is None or any(x in text for x in hold):
            for m in pattern.finditer(text):
                words = m[1].split(" ")
                while words and words[0] in OPENERS:
                    words.pop(0)
                s = m.end(1) - len(" ".join(words))
                if len(words) > 1 and not placed(text, s, m.end(1)):
                    ranked.append((len(PATTERNS) + 1, s, m.end(1), GIVEN.get(words[0].capitalize(), "person")))
    if not ranked:
        return []
    taken: list[tuple[int, int, str]] = []
    for _, s, e, kind in sorted(ranked):
        e -= 2 if kind in NAMES and text[e - 2 : e] in ("'s", "’s") else 0
        at = bisect(taken, (s, e, kind))
        if (not at or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
            insort(taken, (s, e, kind))
    out = [(s, e, kind, canon(kind, text[s:e])) for s, e, kind in taken]
    if titled := sorted(x for x in taken if x[2] in NAMES):
        out += untitled(text, titled, list(zip([0, *(e for _, e, _ in taken)], [*(s for s, _, _ in taken), len(text)], strict=True)))
    return sorted(out, key=lambda x: x[:2])


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[Mention]]:
    """The text with surrogates, and what was found in it. attempts: of the entities that were drawn again."""
    found, out, at = mentions(text), [], 0
    for s, e, kind, named in found:
        value = text[s:e]
        parts = [(k, c, surrogate(key, k, c, attempts.get((k, c), 0))) for k, c in named]
        if kind == "email":
            new = parts[0][2].rpartition("@")[0] + "@" + parts[1][2]
            new = "".join(y.upper() if x.isupper() else y for x, y in zip(value, new, strict=False)) if len(new) == len(value) else new
        elif kind in GENDERS:
            new = " ".join(cased(w, p[2]) for w, p in zip(value.split(" "), parts, strict=True))
        elif kind == "date":
            new = dated(value, parts[0][2])
        elif kind in ("card", "phone", "ssn", "iban"):
            code = "1" if kind == "phone" and sum(map(str.isdecimal, value)) == len(parts[0][1]) + 1 else ""
            new = dress(value, code + parts[0][2])
        else:
            new = parts[0][2]
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), found


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, __t, kind, canonical) of every mention, each once a document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = sorted({(i, *x) for i, t in enumerate(b.column(2).to_pylist()) for *_, named in mentions(t) for x in named})
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "__t", "kind", "canonical"])

    return docs.select("doc_id", "__t", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(found, "doc_id long, __t long, kind string, canonical string")


def drawn(pairs: DataFrame, key: bytes) -> DataFrame:
    """pairs (kind, canonical, attempt) with surrogate."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [surrogate(key, k, c, a) for k, c, a in zip(*(x.to_pylist() for x in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=["kind", "canonical", "attempt", "surrogate"])

    return pairs.select("kind", "canonical", "attempt").mapInArrow(make, "kind string, canonical string, attempt int, surrogate string")


def redrawn(distinct: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt) of the entities whose first surrogate met another's, or an entity of the corpus. Given names are
    held apart across genders, and no part of a name becomes a part of any name of the corpus."""
    group = F.when(F.col("kind").isin(*GENDERS), "given").otherwise(F.col("kind"))  # within it no two surrogates may meet
    realm = F.when(F.col("kind").isin(*NAMES), "name").otherwise(F.col("kind"))  # within it no surrogate may be real
    entity = F.struct("attempt", "canonical", "kind")
    there = distinct.select(realm.alias("realm"), F.col("canonical").alias("surrogate")).distinct()
    state = stored(drawn(distinct.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:  # each round leaves fewer, as surrogates grow longer
        named = state.withColumns({"group": group, "realm": realm})
        lowest = named.groupBy("group", "surrogate").agg(F.count("*").alias("n"), F.min(entity).alias("first")).where("n > 1")
        twice = named.join(lowest, ["group", "surrogate"]).where(entity != F.col("first")).select("kind", "canonical")
        real = named.join(there, ["realm", "surrogate"], "left_semi").select("kind", "canonical")
        bad = stored(twice.union(real).distinct(), "collisions")
        if bad.isEmpty():
            return state.where("attempt > 0").select("kind", "canonical", "attempt")
        again = state.join(bad, ["kind", "canonical"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        state = stored(state.join(bad, ["kind", "canonical"], "left_anti").select("kind", "canonical", "attempt", "surrogate").unionByName(drawn(again, key)), "surrogates")


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per row of docs: doc_id, text (with surrogates; null stays null), n_entities, kinds (sorted, each once).

    The same entity gets the same surrogate everywhere, distinct ones distinct surrogates. Rows that repeat a doc_id are
    treated each by its text; an empty table gives no rows; other columns are ignored. key is a secret: who has it can tell which surrogate
    an entity gets.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_tag(F.col("text")).alias("__t"), "text")
    found = stored(entities(rows), "entities")
    again = stored(redrawn(found.select("kind", "canonical").distinct(), key), "redrawn")
    mark = F.lit(None).cast("array<struct<kind:string,canonical:string,attempt:int>>")
    if again.isEmpty():
        ready = rows.withColumn("__a", mark)
    else:
        own = found.join(again, ["kind", "canonical"]).groupBy("doc_id", "__t").agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias("__a"))
        with_own = by_row(rows, own)
        ready = by_row(rows, own.select("doc_id", "__t"), "left_anti").withColumn("__a", mark).unionByName(with_own)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, count, kinds = [], [], []
            for t, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                new, got = replaced(t or "", key, {(x["kind"], x["canonical"]): x["attempt"] for x in a or []})
                text.append(None if t is None else new)
                count.append(len(got))
                kinds.append(sorted({k for _, _, k, _ in got}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(count, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=["doc_id", "text", "n_entities", "kinds"])

    return ready.select("doc_id", "text", "__a").mapInArrow(apply, "doc_id long, text string, n_entities long, kinds array<string>")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.conf.get(KEY_SETTING, None)
    return pseudonymise(table(spark, sf_dir, "documents"), given.encode() if given else os.urandom(32))
