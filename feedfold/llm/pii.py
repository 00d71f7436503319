"""Surrogates for personal data: entities get keyed replacements of their own type, script and format.

A surrogate depends on the secret key and on the normalised entity (of a name, also on the gender its titles tell), so one
entity has one surrogate in all documents and in all spellings (coreference). Spark checks that no two entities share a
surrogate and that none is itself an entity of the corpus; those that do draw again.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedfold.llm.common import carried, slices, spread_join
from feedfold.session import written

# Titles before a name, by the gender they tell.
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа")
OTHER_TITLES = ("Dr", "Prof")
TITLES = MALE_TITLES + FEMALE_TITLES + OTHER_TITLES

# Every entity has one of these characters, a key's first letters or a title, which a JVM expression finds without Python.
# Spaces are those of Python, which has \x1c to \x1f among them.
MAY_HOLD = r"(?U)[\p{Nd}@=:]|AKIA|ASIA|(^|[^\p{L}])(" + "|".join(TITLES) + r")\.?[\s\x1c-\x1f]"

# Small words inside a name. They stay, as does the first part of names such as O'Brien.
PARTICLES = ("de", "da", "do", "dos", "das", "del", "della", "di", "du", "la", "las", "le", "los", "van", "von", "der", "den", "ten",
             "ter", "zu", "zur", "af", "av", "al", "el", "bin", "bint", "ibn", "ben", "y", "e", "i")

_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f])"
_CAPITAL = r"[^\W\d_a-zа-яß-öø-ÿ]"
_WORD = rf"{_CAPITAL}(?:{_LETTER}+(?:['’-]{_LETTER}+)*|['’]{_LETTER}+(?:['’-]{_LETTER}+)*)"
_INITIALS = rf"(?>(?:{_CAPITAL}\.[ -]?)+)"
_SMALL = rf"(?:{'|'.join(PARTICLES)})(?!\w)"
_NAME = rf"(?:{_INITIALS}\s?)?(?:{_SMALL}\s){{0,3}}{_WORD}(?:\s(?:{_INITIALS}\s?|{_SMALL}\s){{0,3}}{_WORD})*"
_TITLED = rf"(?:(?:{'|'.join(TITLES)})\.?\s)"
_ENTITY = re.compile("|".join((
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![À-ɏͰ-ԯ])"
    r"|[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,24}))",
    r"(?P<aws>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)",
    r"(?i:\b(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|token)\s*[=:]\s*[\"']?)(?P<secret>[^\s\"',;]{6,})",
    r"(?P<hex>\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}\b)",
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
    r"(?P<ip6>(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))",
    r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    r"(?P<card>(?<![\w.-])(?:3\d{3}[ -]\d{6}[ -]\d{4,5}|[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?![\w-]))",
    r"(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
    r"|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))",
    rf"(?<!\w)(?P<titles>{_TITLED}+)(?P<person>{_NAME})",
)))
# Parts of a name that are entities: words, and initials, of which only the letter is replaced.
_PART = re.compile(rf"(?P<initial>(?<!\w){_CAPITAL})\.|{_LETTER}+")
_BARE = re.compile(rf"{_LETTER}+")
_CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдклмнпрст", "greek": "βγδκλμνπρστ"}
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
# Endings of given names by script and gender.
_GIVEN_ENDINGS = {("latin", "f"): ("a", "ia", "ina"), ("latin", "m"): ("o", "an", "us"), ("latin", ""): ("el", "is"),
                  ("cyrillic", "f"): ("а", "ия"), ("cyrillic", "m"): ("ан", "ил"), ("cyrillic", ""): ("ен",),
                  ("greek", "f"): ("α", "ια"), ("greek", "m"): ("ος", "ης"), ("greek", ""): ("ις",)}
# After so many collisions a surrogate may be longer than its entity, as far as the type allows it.
STRETCH = 24
ATTEMPTS = 400


def script_of(text: str) -> str:
    """The script of the first letter: latin, cyrillic, greek, or the first word of its Unicode name."""
    letter = next((c for c in text if c.isalpha()), "a")
    return "latin" if letter.isascii() else unicodedata.name(letter, "latin").partition(" ")[0].lower()


@cache
def _alphabet(block: int, script: str) -> str:
    """Letters of a script in a block of 256 code points; the large scripts have many such blocks."""
    return "".join(c for c in map(chr, range(block << 8, (block + 1) << 8)) if c.isalpha() and c == c.lower() and script_of(c) == script)


def _letter_like(c: str, draw: Keyed) -> str:
    """A letter of the script of ``c``, in lower case."""
    script = script_of(c)
    if script == "latin":
        return draw.of("abcdefghijklmnopqrstuvwxyz")
    if script in _CONSONANTS:
        return draw.of(_CONSONANTS[script] + _VOWELS[script])
    if script == "cjk":
        return chr(0x4E00 + draw.below(0x5000))
    if script == "hangul":
        return chr(0xAC00 + draw.below(0xD7A4 - 0xAC00))
    return draw.of(_alphabet(ord(c.lower()[0]) >> 8, script) or c)


def _luhn_sum(digits: str) -> int:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in twice)


def find_entities(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, normalised value, start, end) of every entity, from left to right; a name's words and initials are entities each.

    The last word of a name has kind family, others are given, with the gender of the title if it tells one.
    """
    out = []
    for m in _ENTITY.finditer(text):
        kind = m.lastgroup
        if kind == "person":
            titles = re.findall(r"[^\s.]+", m["titles"])
            gender = next((g for g, known in (("m", MALE_TITLES), ("f", FEMALE_TITLES)) if any(t in known for t in titles)), "")
            parts = [w for w in _PART.finditer(text, m.start("person"), m.end("person")) if w["initial"] or _is_name(w[0])]
            words = [w for w in parts if not w["initial"]]
            last = words[-1].start() if words else -1
            hyphened = text[:last].rstrip("-").endswith(words[-2][0]) and text[last - 1] == "-" if len(words) > 1 else False
            for w in parts:
                if w["initial"]:
                    out.append(("initial", w["initial"].casefold(), w.start(), w.start() + 1))
                    continue
                family = w.start() == last or hyphened and w.start() == words[-2].start() and len(words) > 2
                value = unicodedata.normalize("NFC", w[0]).casefold()
                out.append(("family" if family else f"given {gender}".strip(), value, w.start(), w.end()))
            continue
        value, (start, end) = m[kind], m.span(kind)
        if kind == "email":
            value = value.lower()
        elif kind == "ip6":
            if len(re.findall(r"\w+", value)) < 3:
                continue
            try:
                value = ipaddress.IPv6Address(value).exploded
            except ValueError:
                continue
        elif kind in ("phone", "ssn", "card", "iban"):
            value = re.sub(r"[^A-Z0-9]", "", value)
            if kind == "card" and (not 13 <= len(value) <= 19 or _luhn_sum(value) % 10):
                continue
            if kind == "phone" and len(value) == 11 and value[0] == "1":  # with and without the country's code is one number
                value = value[1:]
        out.append((kind, value, start, end))
    return out


def _is_name(word: str) -> bool:
    """Neither a particle nor the single letter before an apostrophe."""
    return len(word) > 1 and word not in PARTICLES


def entity_of(kind: str) -> tuple[str, str]:
    """(kind under which an entity is known, gender). A word is one name wherever it stands; bare and assigned secrets are alike."""
    if kind == "family" or kind.startswith("given"):
        return "name", kind[6:] if kind.startswith("given") else ""
    return ("secret" if kind == "hex" else kind), ""


class Keyed:
    """A stream of numbers from the key and a name."""

    def __init__(self, key: bytes, *name: object) -> None:
        self.key, self.name, self.count, self.left = key, "\0".join(map(str, name)).encode(), 0, 0

    def below(self, n: int) -> int:
        if self.left < n * n:
            block = hmac.new(self.key, self.name + b"\0" + str(self.count).encode(), hashlib.sha256).digest()
            self.left, self.state, self.count = 1 << 256, int.from_bytes(block, "big"), self.count + 1
        self.left //= n
        self.state, out = divmod(self.state, n)
        return out

    def of(self, choices):
        return choices[self.below(len(choices))]


def _same_class(text: str, draw: Keyed) -> str:
    """Every letter and digit becomes another of its kind, script and case."""
    out = []
    for c in text:
        if c.isdecimal():
            out.append(chr(ord(c) - int(c) + draw.below(10)))
        elif c.isalpha():
            new = _letter_like(c, draw)
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def initial_of(letter: str, key: bytes) -> str:
    """Initials follow a keyed cycle through their alphabet, so two never become one and none stays."""
    base = letter.casefold()
    alphabet = "abcdefghijklmnopqrstuvwxyz" if base.isascii() else _alphabet(ord(base[0]) >> 8, script_of(base)) or base
    cycle = sorted(alphabet, key=lambda c: hmac.new(key, b"initial\0" + c.encode(), hashlib.sha256).digest())
    new = cycle[(cycle.index(base) + 1) % len(cycle)] if base in cycle else base
    return new.upper() if letter.isupper() and len(new.upper()) == 1 else new


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The attempt-th replacement of a normalised entity; a name's kind may end in its gender (``name f``)."""
    draw = Keyed(key, kind.partition(" ")[0], value, attempt)
    longer = max(0, attempt - STRETCH + 1)
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        site = Keyed(key, "domain", domain)  # one site for all addresses of a domain
        labels[:-1] = [_same_class(x, site) for x in labels[:-1]]
        return _same_class(local + "x" * longer, draw) + "@" + ".".join(labels)
    if kind == "card":  # keeps the first digit, which tells the network
        body = value[0] + "".join(draw.of("0123456789") for _ in value[2:])
        return body + next(c for c in "0123456789" if _luhn_sum(body + c) % 10 == 0)
    if kind == "iban":
        body = _same_class(value[4:], draw)
        return value[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in body + value[:2] + '00')) % 97:02d}" + body
    if kind == "ip":
        return ".".join(str(1 + draw.below(9) if len(p) == 1 else 10 + draw.below(90) if len(p) == 2 else 100 + draw.below(155))
                        if attempt < STRETCH else str(1 + draw.below(254)) for p in value.split("."))
    if kind == "ip6":  # groups that are zero stay
        return ":".join(g if g == "0000" else f"{1 + draw.below(0xffff):04x}" for g in value.split(":"))
    if kind == "phone":  # keeps the first digit, as of a country code
        return value[0] + "".join(draw.of("0123456789") for _ in value[1:])
    if kind == "aws":
        return value[:4] + "".join(draw.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in value[4:])
    if kind.partition(" ")[0] == "name":
        script = script_of(value)
        if script not in _CONSONANTS:  # as many letters of that script
            return "".join(_letter_like(c, draw) for c in value if c.isalpha()) + "".join(_letter_like(value[0], draw) for _ in range(longer))
        ends = _GIVEN_ENDINGS[script, kind[5:]]
        middle = "".join(draw.of(_CONSONANTS[script]) + draw.of(_VOWELS[script]) for _ in range(max(2, len(value) // 3 + longer)))
        return middle + draw.of(_CONSONANTS[script]) + draw.of(ends)
    if re.fullmatch(r"[0-9a-f]+", value):
        return "".join(draw.of("0123456789abcdef") for _ in value + "0" * longer)
    return _same_class(value + "0" * (longer if kind != "ssn" else 0), draw)


def render(kind: str, new: str, seen: str) -> str:
    """A surrogate in the spelling of one mention: its separators, its case, its country code."""
    if kind in ("phone", "ssn", "card", "iban"):
        code = 1 if kind == "phone" and sum(c.isalnum() for c in seen) == 11 and len(new) == 10 else 0
        signs, out = iter(new), []
        for c in seen:
            if c.isalnum() and code:
                code -= 1
                out.append(c)
            else:
                out.append(next(signs, "") if c.isalnum() else c)
        return "".join(out) + "".join(signs)
    if kind == "email":
        return new.upper() if seen.isupper() else new
    if kind == "ip6":
        long = ":".join(g if len(s) == 4 else g.lstrip("0") or "0" for g, s in zip(new.split(":"), seen.split(":"), strict=False))
        out = ipaddress.IPv6Address(new).compressed if "::" in seen else long
        return out.upper() if seen.isupper() else out
    if kind == "name":
        return new.upper() if seen.isupper() else new.title() if seen[0] != seen[0].lower() else new
    return new


def replace_entities(text: str, names: dict[tuple[str, str], str], key: bytes = b"") -> tuple[str, int]:
    """The text with every known entity replaced, and the number of mentions.

    Words of a name are also replaced where they stand in the text without a title, spelled as in the name.
    """
    found = [(*entity_of(kind)[:1], value, start, end) for kind, value, start, end in find_entities(text)]
    spelled = {text[start:end]: value for kind, value, start, end in found if kind == "name"}
    if spelled:
        taken = {i for kind, _, start, end in found for i in (start, end - 1)}
        spans = sorted((start, end) for _, _, start, end in found)
        at, bare = 0, []
        for m in _BARE.finditer(text):
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            if (value := spelled.get(m[0])) is not None and m.start() not in taken and not (at < len(spans) and spans[at][0] < m.end()):
                if not (text[m.start() - 1:m.start()] + text[m.end():m.end() + 1]).strip("'’-").replace("_", "0").isalnum():
                    bare.append(("name", value, m.start(), m.end()))
        found = sorted(found + bare, key=lambda x: x[2])
    out, at, n = [], 0, 0
    for kind, value, start, end in found:
        new = initial_of(text[start:end], key) if kind == "initial" else names.get((kind, value))
        if new is not None:
            out += [text[at:start], render(kind, new, text[start:end])]
            at, n = end, n + 1
    return "".join(out) + text[at:], n


def mentioned(text: str) -> list[tuple[str, str, str]]:
    """Distinct (kind, value, gender) that a text needs surrogates for; initials need none."""
    known = ((*entity_of(kind), value) for kind, value, _, _ in find_entities(text) if kind != "initial")
    return list(dict.fromkeys((kind, value, gender) for kind, gender, value in known))


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [(key, *found) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for found in mentioned(text or "")]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True), (pa.int64(), *[pa.string()] * 3), strict=True)], ["row_key", "kind", "value", "gender"])


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value), without two alike and without one that is an entity.

    A column ``gender`` (m, f or empty), if there is one, chooses the endings of names. In a clash the smallest value keeps its surrogate and the others draw again; a type whose values run out of room raises.
    """
    @F.pandas_udf("string")
    def draw(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, v, a, key) for k, v, a in zip(kind, value, attempt, strict=True)], dtype=object)

    taken, pending = None, entities.select(
        "kind", "value", F.col("gender") if "gender" in entities.columns else F.lit("").alias("gender")).withColumn("attempt", F.lit(0))
    for _ in range(ATTEMPTS):
        drawn = written(pending.withColumn("surrogate", draw(F.rtrim(F.concat_ws(" ", "kind", "gender")), "value", "attempt")), "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"))
        good = drawn.join(first, ["kind", "surrogate"]).filter("value = owner").drop("owner")
        good = good.join(entities.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            good = good.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = good.select("kind", "value", "surrogate")
        taken = written(good if taken is None else taken.unionByName(good), "surrogates")
        pending = drawn.join(taken, ["kind", "value"], "left_anti").select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return taken
    raise RuntimeError("no free surrogates are left for some entities")


def _may_hold(text: Column) -> Column:
    return F.coalesce(text.rlike(MAY_HOLD), F.lit(False))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col``; ``count_col``, if named, gets the number of mentions replaced.

    Finds e-mail and IP addresses, phone, card (with a valid check digit) and social security numbers, IBANs, access keys, hexadecimal
    tokens, assigned secrets and names after a title, of any number of words, with initials, hyphens, apostrophes and particles (which stay).
    A name's words are then replaced wherever the same text has them in the same spelling. Null and empty texts stay as they are; rows
    without an entity are not touched or shuffled; very long texts are read whole; ids may be null or repeat; an empty table gives an
    empty result; all other columns are kept, whatever their names.
    """
    text = F.col("row")[text_col]
    keyed, _ = carried(docs.filter(_may_hold(F.col(text_col))), id_col, text_col)
    mentions = written(keyed.select("row_key", F.col("row")[text_col].alias("text"))
                       .mapInArrow(_mentions, "row_key long, kind string, value string, gender string").distinct(), "mentions")
    male, female = (F.max((F.col("gender") == g).cast("int")) for g in "mf")
    gender = F.when(male > female, "m").when(male < female, "f").otherwise("")  # of both or none, endings that tell nothing
    entities = written(mentions.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), gender.alias("gender")), "entities")
    names = written(entities.drop("gender").join(assign_surrogates(entities, key.encode()), ["kind", "value"]), "entity-names")
    secret = key.encode()
    known = spread_join(mentions, names, ["kind", "value"], "n").groupBy("row_key").agg(
        F.collect_list(F.struct("kind", "value", "surrogate")).alias("names"))

    @F.pandas_udf("new string, n int")
    def rewrite(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = [replace_entities(t, {(x["kind"], x["value"]): x["surrogate"] for x in (() if found is None else found)}, secret)
               if t else (t, 0)
               for t, found in zip(texts, lists, strict=True)]
        return pd.DataFrame(out, columns=["new", "n"])

    changed = keyed.join(known, "row_key", "left").select(
        "row", rewrite(F.col("row")[text_col], F.col("names")).alias("out"))
    plain = docs.filter(~_may_hold(F.col(text_col))).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    others = [c for c in docs.columns if c != text_col and c != count_col]

    def columns(new: Column, n: Column) -> list[Column]:
        found = {c: F.col("row")[c].alias(c) for c in others} | {text_col: new.alias(text_col)}
        order = [found[c] for c in docs.columns if c in found]
        return order + ([n.cast("int").alias(count_col)] if count_col else [])

    return (changed.select(*columns(F.col("out.new"), F.col("out.n")))
            .unionByName(plain.select(*columns(text, F.lit(0)))))
