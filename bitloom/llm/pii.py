"""Surrogates for personal data: detected entities are replaced by made-up ones of the same type, script and format.

An entity's normal form (case, and for numbers their separators, left out) is a number in a mixed-radix system: each
position draws from the characters of its class (digits, vowels, consonants, by script; in scripts without such a table,
the letters of the same block of code points). A keyed Feistel permutation p of
that range gives the surrogate p^-1(p(x) + 1). It is a bijection without fixed points, so that equal entities get equal
surrogates in all documents (coreference), different ones of a shape different surrogates (distinctness), and none keeps
its own, with no table to share or to shuffle. Given names that are listed are permuted within the list of their gender
and script; an unlisted one after a title that tells a gender gets a name of that gender with a hyphen before its own
surrogate, so that names of different persons differ in all documents. collisions() checks a corpus.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import common

KEY = b"bitloom surrogate key"
ROUNDS = 8

#: Classes of characters, given names by script and gender, and titles with their gender.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäåáãæèéêëíìîïóòôöõøúùûüýœ", "çñßšžčćđłńśźżř",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ",
)
NAMES = {
    ("latin", "m"): "james john robert michael david thomas peter paul martin hans karl stefan jürgen pierre jean luc antoine carlos juan miguel luis pablo diego".split(),
    ("latin", "f"): "mary anna linda susan sarah emma laura julia petra claudia ingrid sabine marie claire sophie camille maria carmen lucia elena isabel sofia".split(),
    ("cyrillic", "m"): "иван алексей дмитрий сергей николай павел михаил андрей".split(),
    ("cyrillic", "f"): "анна мария ольга елена наталья ирина татьяна светлана".split(),
}
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m",
    "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f", "господин": "m", "госпожа": "f",
}

_NAME = r"[^\W\d_a-zà-öø-ÿа-я][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_LISTED = "|".join(n.capitalize() for names in NAMES.values() for n in names)
#: What is detected, in order of precedence.
PATTERNS = {
    "email": r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)\b\W{1,6}(?P<value>[\w+/=-]{12,}))",
    "hex": r"(?<![\w-])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?![\w-])",
    "key": r"(?<![\w-])(?:sk|pk|ghp|gho|xox[abp]|AKIA|AIza)[\w-]{16,}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)",
    "number": r"(?<![\w.,])\d{9,12}(?![\w])",
    "person": rf"(?<!\w)(?:(?P<title>{'|'.join(TITLES)})\.?\s+(?P<names>{_NAME}(?:[ ]{_NAME}){{0,2}})|(?P<listed>(?:{_LISTED})(?:[ ]{_NAME}){{1,2}})(?!\w))",
}
_PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: An entity has a digit, an "@", a title or a listed given name, or is one of the kinds that need none of these.
_SOME = re.compile(r"[\d@]")
_PERSON = [t for t in TITLES] + [n.capitalize() for names in NAMES.values() for n in names]
_PLAIN = [re.compile(PATTERNS[k]) for k in ("secret", "key")]
SPANS = "array<struct<type:string,start:int,end:int,surrogate:string>>"


def _kind(m: re.Match) -> str:
    return next(k for k in PATTERNS if m.group(k) is not None)


def _entities(text: str) -> Iterator[tuple[str, int, int, re.Match]]:
    """Kind, start, end and match of each entity. What fails a check is searched again from its second character on."""
    m = _PATTERN.search(text)
    while m:
        kind, at = _kind(m), m.end()
        a, b = m.span({"secret": "value", "person": "names" if m["names"] else "listed"}.get(kind, kind))
        if kind == "phone":
            b = at = _phone_end(text, a, b)
        if b is not None:
            yield kind, a, b, m
        m = _PATTERN.search(text, m.start() + 1 if at is None else at)


def _phone_end(text: str, a: int, b: int) -> int | None:
    """Where the phone number ends that starts the match: before the first entity that follows it within the match, or else
    after as many groups as make 8 to 15 digits."""
    ends = [e for e in (*(k for k in range(a + 1, b) if text[k] in " .-" and text[k - 1].isdecimal()), b) if 8 <= sum(c.isdecimal() for c in text[a:e]) <= 15]
    for e in ends[:-1] if ends and ends[-1] == b else ends:
        m = _PATTERN.match(text, e + 1)
        if m and (_kind(m) != "phone" or _phone_end(text, *m.span())):
            return e
    return ends[-1] if ends else None


#: Other letters and digits form classes of one category and script within so many neighbouring code points.
_BLOCK = 128


@cache
def _block(k: int) -> dict[str, str]:
    """The class of each character in lower case of a block; a character alone in its class is left out."""
    found: dict[tuple[str, str], list[str]] = {}
    for c in map(chr, range(k * _BLOCK, (k + 1) * _BLOCK)):
        if c.isalnum() and (c.lower() == c or len(c.lower()) > 1) and not any(c in k for k in CLASSES):
            found.setdefault((unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]), []).append(c)
    return {c: "".join(group) for group in found.values() if len(group) > 1 for c in group}


@cache
def _single() -> str:
    """The characters that are alone in their classes: a class of their own."""
    lone = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and (c.lower() == c or len(c.lower()) > 1)]
    return "".join(c for c in lone if not any(c in k for k in CLASSES) and c not in _block(ord(c) // _BLOCK))


def _class(c: str) -> str | None:
    """The characters, in lower case, that may stand for c; None if it is no letter or digit."""
    return next((k for k in CLASSES if c in k), None) or (None if not c.isalnum() else _block(ord(c) // _BLOCK).get(c) or _single())


def _head(name: str) -> str:
    return name.split("-")[0]


_HEADS = {n: k for k, names in NAMES.items() for n in names}


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, r: int, half: int, bits: int) -> int:
        size = -(-bits // 8)
        data, out, n = half.to_bytes(size + 1, "big"), b"", 0
        while len(out) < size:
            out += hashlib.blake2b(data, key=self.key[:64], person=bytes([r, n]), salt=hashlib.blake2b(tweak, digest_size=16).digest()).digest()
            n += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _permuted(self, x: int, size: int, tweak: bytes, back: bool) -> int:
        """A permutation of range(size), or its inverse: a Feistel network over as many bits, walked until inside."""
        bits = max(1, -(-(size - 1).bit_length() // 2))
        while True:
            left, right = x >> bits, x & ((1 << bits) - 1)
            for r in range(ROUNDS):
                if back:
                    left, right = right ^ self._round(tweak, ROUNDS - 1 - r, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, r, right, bits)
            x = left << bits | right
            if x < size:
                return x

    def number(self, x: int, size: int, tweak: bytes) -> int:
        """A bijection of range(size) that moves every number (if size is over 1)."""
        return self._permuted((self._permuted(x, size, tweak, False) + 1) % size, size, tweak, True) if size > 1 else x

    def _mixed(self, value: list[int], sizes: list[int], tweak: bytes) -> list[int]:
        x, size = 0, 1
        for v, s in zip(value, sizes, strict=True):
            x, size = x * s + v, size * s
        x, out = self.number(x, size, tweak), []
        for s in reversed(sizes):
            x, v = divmod(x, s)
            out.append(v)
        return out[::-1]

    def shaped(self, text: str, tweak: str, alphabet: str | None = None) -> str:
        """Each character becomes one of its class, in the case it has; others stay."""
        low = [c.lower() if len(c.lower()) == 1 else c for c in text]
        kinds = [alphabet if alphabet and c in alphabet else _class(c) for c in low]
        at = [i for i, k in enumerate(kinds) if k]
        shape = tweak + ":" + "".join(str(CLASSES.index(k)) if k in CLASSES else "x" if k == alphabet else k[0] for k in (kinds[i] for i in at))
        new = self._mixed([kinds[i].index(low[i]) for i in at], [len(kinds[i]) for i in at], shape.encode())
        out = list(text)
        for i, v in zip(at, new, strict=True):
            c = kinds[i][v]
            out[i] = c.upper() if (text[i] != low[i] or alphabet and text.isupper()) and len(c.upper()) == 1 and c.upper().lower() == c else c
        return "".join(out)

    def digits(self, text: str, tweak: str, fixed: int = 0) -> str:
        """The digits of text as one number, its separators kept; a first digit other than 0 stays so. The last fixed digits
        stay."""
        at = [i for i, c in enumerate(text) if c.isdecimal()]
        at = at[: len(at) - fixed]
        value, low = [int(text[i]) for i in at], int(text[at[0]] != "0")
        new = self._mixed([value[0] - low if low else 0, *value[1:]], [9 if low else 1, *[10] * (len(at) - 1)], f"{tweak}:{len(at)}:{low}".encode())
        out = list(text)
        for i, v in zip(at, [new[0] + low, *new[1:]], strict=True):
            out[i] = str(v)
        return "".join(out)

    def card(self, text: str) -> str:
        """As digits, with a check digit as right or as wrong as before."""
        off = (int(re.sub(r"\D", "", text)[-1]) - _luhn(text)) % 10
        new = self.digits(text, "card", 1)
        at = max(i for i, c in enumerate(new) if c.isdecimal())
        return f"{new[:at]}{(_luhn(new) + off) % 10}{new[at + 1:]}"

    def ip(self, text: str) -> str:
        octets = [int(o) for o in text.split(".")]
        inner = [k for k, o in enumerate(octets) if 0 < o < 255]
        new = self._mixed([octets[k] - 1 for k in inner], [254] * len(inner), f"ip:{inner}".encode())
        for k, v in zip(inner, new, strict=True):
            octets[k] = v + 1
        return ".".join(map(str, octets))

    def email(self, text: str) -> str:
        body, _, top = text.rpartition(".")
        return f"{self.shaped(body, 'email:' + top.lower())}.{top}"

    def iban(self, text: str) -> str:
        new = text[:4] + self.shaped(text[4:], "iban:" + text[:2])
        check = _iban_check(new) if int(text[2:4]) == _iban_check(text) else text[2:4]
        return f"{new[:2]}{check:0>2}{new[4:]}"

    def person(self, names: str, gender: str) -> str:
        """Given name and surnames. A listed given name stays in its list. Another one becomes one that is not listed; if its
        gender is known, a listed name goes before it, with a hyphen."""
        first, *rest = names.split(" ")
        if not rest:
            return self.shaped(first, "surname")
        low = first.lower()
        listed = next(((k, n) for k, n in NAMES.items() if low in n and gender in ("", k[1])), None)
        if listed:
            new = listed[1][self.number(listed[1].index(low), len(listed[1]), repr(listed[0]).encode())]
        else:
            new = self.shaped(low, "given")
            script, head = unicodedata.name(first[0], "").split(" ")[0].lower(), _HEADS.get(_head(low))
            own = NAMES.get((script, gender), head and NAMES[head])
            if own:
                new = f"{own[self._round(low.encode(), 20, 0, 32) % len(own)]}-{new}"
            while not own and _head(new) in _HEADS:  # a permutation of the names without a listed head
                new = self.shaped(new, "given")
        given = new.upper() if first.isupper() else "-".join(p.capitalize() for p in new.split("-"))
        return " ".join([given, *(self.shaped(n, "surname") for n in rest)])

    def replaced(self, text: str) -> tuple[str, list[dict]]:
        """The text with surrogates, and where entities stood in the original."""
        if not _SOME.search(text) and not any(t in text for t in _PERSON) and not any(p.search(text) for p in _PLAIN):
            return text, []
        out, spans, at = [], [], 0
        for kind, a, b, m in _entities(text):
            part = text[a:b]
            if kind in ("secret", "hex", "key"):
                is_hex = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", part)
                new = self.shaped(part, "hex", "0123456789abcdef") if is_hex else self.shaped(part, "secret")
            elif kind in ("email", "iban", "ip", "card"):
                new = getattr(self, kind)(part)
            elif kind == "person":
                new = self.person(part, TITLES.get(m["title"] or "", ""))
            else:
                new = self.digits(part, "digits")
            if new == part:  # nothing in it can change, as in 0.0.0.0
                continue
            out += [text[at:a], new]
            spans.append({"type": kind, "start": a, "end": b, "surrogate": new})
            at = b
        return ("".join([*out, text[at:]]), spans) if spans else (text, spans)


def _luhn(text: str) -> int:
    """The right check digit for the digits of text but the last."""
    d = [int(c) for c in text if c.isdecimal()][:-1]
    return -sum(sum(divmod(2 * v, 10)) if k % 2 == 0 else v for k, v in enumerate(reversed(d))) % 10


def _iban_check(text: str) -> int:
    plain = text.replace(" ", "")
    return 98 - int("".join(str(int(c, 36)) for c in plain[4:] + plain[:2] + "00")) % 97


@cache
def _surrogates(key: bytes) -> Surrogates:
    return Surrogates(key)


def replace(docs: DataFrame, key: bytes = KEY, text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """docs with surrogates in text_col; all rows and other columns stay as they are.

    spans_col names a new column with the entities: type, start and end in the original text, surrogate. Null and empty
    texts stay as they are and have no entities; equal texts become equal texts. An empty table gives no rows.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    plain = docs.toDF(*names).withColumn(names[at], F.col(names[at]).cast("string"))

    def make():
        s = _surrogates(key)

        def work(batch: pa.RecordBatch) -> dict:
            found = [(None, []) if t is None else s.replaced(t) for t in batch.column(names[at]).to_pylist()]
            out = {n: batch.column(n) for n in names} | {"spans": [e for _, e in found]}
            return out | {names[at]: pa.array([t for t, _ in found], batch.schema.field(names[at]).type)}

        return work

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    out = common.map_batches(plain, make, f"{schema}, spans {SPANS}")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)), *([F.col("spans").alias(spans_col)] if spans_col else []))


def collisions(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """(type, surrogate, originals): surrogates that stand for more than one entity of a type in the corpus."""
    found = replace(docs.select(F.col(text_col).alias("text"), F.col(text_col).alias("was")), key, "text", "spans")
    each = found.select("was", F.explode("spans").alias("e")).select("e.type", F.lower("e.surrogate").alias("surrogate"), F.lower(F.expr("substring(was, e.start + 1, e.end - e.start)")).alias("original"))
    number = F.col("type").isin("phone", "card", "ssn", "number")
    plain = lambda c: F.when(number, F.regexp_replace(c, r"\D", "")).otherwise(F.col(c)).alias(c)
    each = each.select("type", plain("surrogate"), plain("original")).distinct()
    return each.groupBy("type", "surrogate").agg(F.count("*").alias("originals")).where("originals > 1")
