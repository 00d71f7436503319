"""Scalar text operators as column expressions (no Python in the row path)."""

from __future__ import annotations

import re
import string
import sys
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a short text as English.
ENGLISH_MARKERS = ("the", "and", "is", "it", "app", "this", "great", "love", "bad", "good")

# Whitespace as str.strip(), str.split() and \s see it, as characters and as a class.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0         "
          "       　")
SPACE_CLASS = r"\x09-\x0d\x1c-\x20\x85\xa0  -     　"
# Those of them in ASCII one by one, which a pattern tests faster than ranges.
ASCII_SPACES = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f "
# A word character: letter, number or underscore.
WORD_CLASS = r"\p{L}\p{N}_"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_ascii(text: Column | str) -> Column:
    return F.octet_length(text) == F.length(text)


def strip(value: Column | str) -> Column:
    return F.btrim(_col(value), F.lit(SPACES))


def _where(found: Column, text: Column, pattern: str, replacement: str) -> Column:
    """Replace in texts that ``found`` holds for; NULL stays NULL."""
    return F.when(found, F.regexp_replace(text, pattern, replacement)).otherwise(text)


def clean_text(value: Column | str, empty_as_none: bool = False) -> Column:
    """Unix line ends, single spaces, at most one blank line, no outer whitespace.

    A pattern runs only over texts that hold what it changes, and matches only there: ordinary text is neither scanned by it nor rebuilt.
    """
    text = _col(value).cast("string")
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.when(F.contains(text, F.lit("\r")), unix).otherwise(text)
    text = _where(F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\t")), text, r"[ \t](?:[ \t]++|(?<=\t))", " ")
    text = strip(_where(F.contains(text, F.lit("\n\n\n")), text, r"\n{3,}", "\n\n"))
    return F.nullif(text, F.lit("")) if empty_as_none else F.coalesce(text, F.lit(""))


@cache
def _other_digits() -> tuple[str, str]:
    """The decimal digits beyond ASCII, and the ASCII digits they stand for."""
    found = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal())
    return found, "".join(str(int(c)) for c in found)


def safe_int(value: Column | str) -> Column:
    """Integer text (sign, decimal digits of any script, single underscores, outer whitespace) to BIGINT, else NULL."""
    text = strip(_col(value).cast("string"))
    text = F.when(is_ascii(text), text).otherwise(F.translate(text, *_other_digits()))
    digits = F.regexp_extract(text, r"\A[+-]?[0-9]+(?:_[0-9]+)*\z", 0)
    return F.replace(digits, F.lit("_"), F.lit("")).try_cast("bigint")


# ISO 8601 date (extended or compact), optionally one separator, a time and an offset; each piece
# of the time may be left out from the right.
_ISO_DATE = r"(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))"
_ISO_OFFSET = r"(Z|[+-]\d{2}(?::?\d{2})?)?"
_ISO = {
    rf"(?s)\A{_ISO_DATE}\z": "$1-$2$4-$3$5T00:00:00Z",
    rf"(?s)\A{_ISO_DATE}.(\d{{2}}){_ISO_OFFSET}\z": "$1-$2$4-$3$5T$6:00:00$7",
    rf"(?s)\A{_ISO_DATE}.(\d{{2}}):?(\d{{2}}){_ISO_OFFSET}\z": "$1-$2$4-$3$5T$6:$7:00$8",
    rf"(?s)\A{_ISO_DATE}.(\d{{2}}):?(\d{{2}}):?(\d{{2}})(?:[.,]\d+)?{_ISO_OFFSET}\z": "$1-$2$4-$3$5T$6:$7:$8$9",
}
_CANONICAL = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)\z"


# ISO week date, extended or compact; the weekday may be left out.
_ISO_WEEK = r"\A(\d{4})(?:-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)(?![\d-])"


def _week_date_as_date(text: Column) -> Column:
    """A week date at the start of ``text`` as year, month and day; unchanged where there is none or no such week."""
    def number(*groups: int) -> Column:
        return F.nullif(F.concat(*[F.regexp_extract(text, _ISO_WEEK, g) for g in groups]), F.lit("")).cast("int")

    year, week, day = number(1), number(2, 4), F.coalesce(number(3, 5), F.lit(1))
    january = F.when(year.between(1, 9999), F.make_date(year, F.lit(1), F.lit(4)))  # is always in week 1
    date = F.date_add(F.date_sub(january, F.weekday(january)), (week - 1) * 7 + day - 1)
    exists = day.between(1, 7) & (F.weekofyear(date) == week) & (F.extract(F.lit("YEAROFWEEK"), date) == year)
    plain = F.concat(F.date_format(date, "yyyy-MM-dd"), F.regexp_replace(text, _ISO_WEEK, ""))
    return F.when(F.substring(text, 5, 2).contains("W"), F.when(exists, plain)).otherwise(text)


def parse_timestamp(value: Column | str) -> Column:
    """ISO text (calendar or week date) to TIMESTAMP; without an offset it is UTC, fractions are cut, bad input is NULL.

    Each accepted form is rewritten to one canonical text in a chain of replacements; whatever is not
    canonical in the end was not ISO and casts to NULL.
    """
    text = _week_date_as_date(strip(_col(value).cast("string")))
    for pattern, canonical in _ISO.items():
        text = F.regexp_replace(text, pattern, canonical)
    text = F.regexp_replace(text, r"(T[\d:]{8})\z", "$1Z")
    text = F.regexp_replace(text, r"(T[\d:]{8}[+-]\d\d)\z", "$1:00")
    text = F.regexp_replace(text, r"(T[\d:]{8}[+-]\d\d)(\d\d)\z", "$1:$2")
    return F.nullif(F.regexp_extract(text, _CANONICAL, 0), F.lit("")).try_cast("timestamp")


def iso_utc(value: Column | str) -> Column:
    return F.date_format(_col(value), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _beyond_ascii(text: Column) -> Column:
    """The text's characters beyond ASCII; a pattern that looks for some of these has little to read."""
    return F.regexp_replace(text, r"\p{ASCII}++", "")


def detect_language(text: Column | str) -> Column:
    """'en' when nine of ten letters are ASCII and the text is long enough or holds a marker word.

    In an ASCII text every letter is ASCII, so a look at its first letters decides; letters are only counted in other texts, each
    kind once: the counts stand in one value, and the rule for them is a function of it.
    """
    text = _col(text)
    plain_letters = F.length(F.regexp_replace(text, f"[^{string.ascii_letters}]++", ""))
    other_letters = F.length(F.regexp_replace(_beyond_ascii(text), r"\P{L}++", ""))
    marked = F.concat(F.lit(" "), F.lower(text), F.lit(" ")).rlike(" (?:" + "|".join(ENGLISH_MARKERS) + ") ")
    twelve = r"\A(?:[^A-Za-z]*+[A-Za-z]){12}"
    plain = F.left(text, F.lit(256)).rlike(twelve) | text.rlike(twelve) | (text.rlike("[A-Za-z]") & marked)

    def rule(letters: Column) -> Column:
        total = letters["plain"] + letters["other"]
        return (F.try_divide(letters["plain"], total) >= 0.9) & ((total >= 12) | marked)

    counts = F.array(F.struct(plain_letters.alias("plain"), other_letters.alias("other")))
    english = F.when(is_ascii(text), plain).otherwise(F.get(F.transform(counts, rule), F.lit(0)))
    return F.when(english, F.lit("en")).otherwise(F.lit("unknown"))


def flat_text(text: Column | str) -> Column:
    """Every run of whitespace as one space; only texts with a space beyond ASCII take the pattern that knows those, the others one of
    plain character tests. A single space is no match."""
    text = _col(text)

    def flat(spaces: str) -> Column:
        return F.regexp_replace(text, f"[{spaces}](?:[{spaces}]++|(?<! ))", " ")

    narrow = is_ascii(text) | ~_beyond_ascii(text).rlike(f"[{SPACE_CLASS}]")
    return F.trim(F.when(narrow, flat(ASCII_SPACES)).otherwise(flat(SPACE_CLASS)))


def token_estimate(flat: Column | str) -> Column:
    """Whitespace-separated tokens of a flattened text, by its gaps."""
    return F.when(F.length(flat) > 0, occurrences(flat, " ") + 1).otherwise(0)


def word_count(text: Column | str) -> Column:
    """Runs of word characters and apostrophes that hold at least one word character."""
    mark = "\x01"
    marked = F.regexp_replace(F.replace(_col(text), F.lit(mark), F.lit(" ")),
                              f"'*+[{WORD_CLASS}][{WORD_CLASS}']*+", mark)
    return occurrences(marked, mark)


def occurrences(text: Column | str, char: str) -> Column:
    return F.length(_col(text)) - F.length(F.replace(_col(text), F.lit(char), F.lit("")))


def redact_text(text: Column | str, limit: int = 180) -> Column:
    value = F.regexp_replace(_col(text), rf"https?://[^{SPACE_CLASS}]+|www\.[^{SPACE_CLASS}]+", "[URL]")
    word = f"[{WORD_CLASS}]"
    mail = rf"(?<!{word})(?={word})[{WORD_CLASS}.+-]+@[{WORD_CLASS}.-]+\.[A-Za-z]{{2,}}(?!{word})"
    value = F.regexp_replace(value, mail, "[EMAIL]")
    value = strip(F.regexp_replace(value, f"[{SPACE_CLASS}]+", " "))
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit)), F.lit("…"))).otherwise(value)


def ascii_fold(text: Column | str) -> Column:
    """Trim spaces and lower-case A-Z only, the equality used by the duplicate-body test."""
    trimmed = F.trim(_col(text))
    return F.when(is_ascii(text), F.lower(trimmed)).otherwise(
        F.translate(trimmed, string.ascii_uppercase, string.ascii_lowercase))


def term_pattern(terms: list[str] | tuple[str, ...]) -> str | None:
    """One case-insensitive, word-bounded alternation for ``terms``; None when no term is left.

    A look at the first letter comes first: it rules out most positions at once.
    """
    escaped, starts = [], set()
    for term in terms:
        words = str(term).split()
        if words:
            escaped.append(f"[{SPACE_CLASS}]+".join(re.sub(r"([^\w\s])", r"\\\1", word) for word in words))
            starts.add(re.sub(r"([^\w\s])", r"\\\1", words[0][0]))
    if not escaped:
        return None
    return rf"(?iu)(?=[{''.join(sorted(starts))}])(?<![{WORD_CLASS}])(?:{'|'.join(escaped)})(?![{WORD_CLASS}])"


# What a case-insensitive pattern takes for an ASCII letter besides that letter's two cases.
_ASCII_TWINS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
# A look for more literals than this costs more than the pattern that it saves.
MOST_LITERALS = 16


def holds_any(low: Column, literals: set[str]) -> Column | None:
    """True where the lower-case text ``low`` holds one of ``literals``; None when these are too many, or none, for a plain look."""
    least = sorted(x for x in literals if not any(y in x for y in literals if y != x))
    if not 0 < len(least) <= MOST_LITERALS:
        return None
    return reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in least])


def folded(text: Column | str) -> Column:
    """Lower case, and an ASCII letter for whatever a case-insensitive pattern takes for it."""
    text = _col(text)
    for twin, letter in _ASCII_TWINS.items():
        text = F.replace(text, F.lit(twin), F.lit(letter))
    return F.lower(text)


def has_term(text: Column | str, terms: list[str] | tuple[str, ...], low: Column | None = None) -> Column:
    """With ``low``, a column that holds the text ``folded``, the pattern runs only over texts with the longest word of some term."""
    pattern = term_pattern(terms)
    if not pattern:
        return F.lit(False)
    words = {max(str(term).split(), key=len).lower() for term in terms if str(term).split()}
    held = holds_any(low, words) if low is not None and all(word.isascii() for word in words) else None
    found = _col(text).rlike(pattern)
    return found if held is None else held & found


def author_fingerprint(platform: Column | str, uri: Column | str, label: Column | str) -> Column:
    identity = F.coalesce(_col(uri), _col(label))
    return F.when(identity.isNotNull(), F.sha2(F.concat_ws("|", _col(platform), identity), 256))
