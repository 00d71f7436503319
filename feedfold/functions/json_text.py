"""Canonical JSON text: what a JSON reader with whole integers and shortest floats writes back, keys sorted.

VARIANT sorts keys and nests to any depth, but forgets how a number was spelled. Before the parse each number that VARIANT would
change becomes a string between two marks; after the parse the marks and quotes go. No value is parsed in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# A noncharacter, which texts for interchange do not hold. A text that has it is parsed as VARIANT alone does.
MARK = "\ufdd0"

# Strings (an open one runs to the end), numbers, the three words for numbers without a value, and runs of all else.
# A number before a colon is no key; it stays as it is, so that the text stays broken.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"?+'
_NUMBER = r'-?+(?:0|[1-9]\d*+)(?:\.\d++)?+(?:[eE][+-]?+\d++)?+(?!\s*+:)'
_WORD = r'NaN|-?+Infinity'
_TOKENS = rf'(?s){_STRING}|{_NUMBER}|{_WORD}|[^"\-0-9NI]++|.'
_RESPELLED = r'^(?:-?\d+(?:\.\d+)?[eE][+-]?\d+|-?\d+\.\d+|-?\d{19,}|NaN|-?Infinity)$'
# The look at the number's first character comes first: it rules out most positions at once. A number follows the start, a colon, comma or bracket, with or
# without blanks between, so one behind a word and a blank stands in a string.
_MAY_HOLD = r'(?=[0123456789NI])(?<=(?:^\s?|[:,\[]|[:,\[\s]\s)-?)(?:\d+[.eE]|\d{19}|NaN|Infinity)'


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits_text(digits: Column, exponent: Column) -> Column:
    """Digits ``d.ddd`` times ten to ``exponent``: plain from 1e-4 up to below 1e16, else with an exponent of two digits or more."""
    point, size, one = exponent + 1, F.length(digits), F.lit(1)
    zeros = lambda n: F.repeat(F.lit("0"), n)
    power = F.abs(exponent)
    return (F.when(size == 0, "0.0")
            .when((point > -4) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits))
            .when((point > 0) & (point <= 16) & (size <= point), F.concat(digits, zeros(point - size), F.lit(".0")))
            .when((point > 0) & (point <= 16), F.concat(F.substr(digits, one, point), F.lit("."), F.substr(digits, point + 1)))
            .otherwise(F.concat(
                F.substr(digits, one, one), F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
                F.when(exponent < 0, "e-").otherwise("e+"), F.when(power < 10, "0").otherwise(""), power.cast("string"))))


def float_text(size: Column) -> Column:
    """Shortest text of a double that is not negative: the fewest of 15, 16 or 17 digits that read back as the same number.

    Below 2.3e-308, where doubles have fewer digits, the text may be longer than the shortest one.
    """
    spelled = [F.format_string(f"%.{n}e", size) for n in (14, 15, 16)]
    shortest = F.coalesce(*[F.when(s.cast("double") == size, s) for s in spelled[:2]], spelled[2])
    parts = _let(shortest, lambda s: F.split(s, "e"))
    return F.when(size == float("inf"), "Infinity").otherwise(_let(parts, lambda p: _digits_text(
        F.regexp_replace(F.replace(F.get(p, F.lit(0)), F.lit("."), F.lit("")), "0+$", ""), F.get(p, F.lit(1)).cast("int"))))


def _respelled(token: Column) -> Column:
    sign, size = F.when(F.startswith(token, F.lit("-")), "-").otherwise(""), F.regexp_replace(token, "^-", "")
    whole_or_word = token.rlike(r"^(?:-?\d+|NaN|-?Infinity)$")
    return F.when(whole_or_word, token).otherwise(F.concat(sign, _let(size.cast("double"), float_text)))


def marked(text: Column | str) -> Column:
    """The JSON text with each float, long integer and number word as a marked string in its canonical spelling."""
    text = F.col(text) if isinstance(text, str) else text
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), 0), lambda t: F.when(
        t.rlike(_RESPELLED), F.concat(F.lit(f'"{MARK}'), _respelled(t), F.lit(f'{MARK}"'))).otherwise(t))
    return F.when(text.rlike(_MAY_HOLD) & ~F.contains(text, F.lit(MARK)), F.array_join(tokens, "")).otherwise(text)


def unmarked(text: Column) -> Column:
    """Text or JSON text taken from a marked document, with its numbers as numbers."""
    bare = F.regexp_replace(F.regexp_replace(text, f'"{MARK}([^"{MARK}]*){MARK}"', "$1"), f"^{MARK}([^{MARK}]*){MARK}$", "$1")
    return F.when(F.contains(text, F.lit(MARK)), bare).otherwise(text)


def allow_repeated_keys(spark: SparkSession) -> None:
    """Of a repeated key the last one counts; without this such a text does not parse. Read when a parse is planned."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parse_document(text: Column | str) -> Column:
    """VARIANT of a JSON text, NULL for a broken one; take texts out of it through ``unmarked``.

    A VARIANT parse stops behind the first value. So the text is parsed as the first of two fields, and whatever follows its value
    breaks the object, hides the second field or adds a third.
    """
    return _let(document_fields(text), field_document)


def document_fields(text: Column | str) -> Column:
    """The two fields; where the parse is a projection of its own, ``field_document`` of their column is what ``parse_document`` gives."""
    framed = F.concat(F.lit(f'{{"{MARK}":'), marked(text), F.lit(f',"{MARK}{MARK}":0}}'))
    return F.try_variant_get(F.try_parse_json(framed), "$", "map<string,variant>")


def field_document(fields: Column) -> Column:
    first, second = F.lit(MARK), F.lit(f"{MARK}{MARK}")
    return F.when((F.size(fields) == 2) & F.map_contains_key(fields, second), F.try_element_at(fields, first))


def written_json(document: Column) -> Column:
    """Canonical text of a VARIANT that ``parse_document`` gave: sorted keys, no blanks, only needed escapes, in lower case."""
    text = unmarked(F.to_json(document))
    lowered = text
    for digit in "ABCDEF":
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*+)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return F.when(F.contains(text, F.lit("\\u00")), lowered).otherwise(text)


def canonical_json(text: Column | str) -> Column:
    """NULL for NULL and for text that is no JSON. Keys that differ only beyond U+DFFF are sorted by their UTF-16 units."""
    return written_json(parse_document(text))
