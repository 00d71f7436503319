"""Surrogates against a replacer in plain Python, and the names, numbers and scripts that they cover."""

import collections
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from feedfold.llm import pii

SF = "/root/testdata/sf0.001"
KEY = "a key"


def plainly(texts):
    """All texts replaced without Spark: one dictionary of surrogates, drawn again in rounds while two clash."""
    genders = collections.defaultdict(set)
    for t in texts:
        for kind, start, gender in pii.mentioned(t or ""):
            genders[kind, start].add(gender)
    names, pending, attempt = {}, sorted(genders), 0
    while pending:
        drawn = collections.defaultdict(list)
        for kind, value in pending:
            known = genders[kind, value] - {""}
            full = f"{kind} {known.pop()}" if len(known) == 1 else kind
            drawn[kind, pii.surrogate(full, value, attempt, KEY.encode())].append(value)
        used = {(kind, new) for (kind, _), new in names.items()}
        for (kind, new), values in drawn.items():
            if (kind, new) not in genders and (kind, new) not in used:
                names[kind, min(values)] = new
        pending, attempt = [p for p in pending if p not in names], attempt + 1
    return [pii.replace_entities(t, names, KEY.encode()) if t else (t, 0) for t in texts], names


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.replace_pii(docs, KEY, count_col="n").orderBy("doc_id").collect()
    return [(r.text, r.n) for r in rows]


NAMED = [
    "Señora Ana María López García came. López left.", "Dr. J. Smith and Mr John Smith, then Smith; John too, not Johnson.",
    "Mr O'Brien, Mr. J. R. R. Tolkien; Ms Mary-Jane Smith", "Ms Maria de la Cruz saw Prof. Dr. Anna Schmidt-Müller.", "Mr 王伟 and Mr محمد علي",
    "Dr John Smith is Mr John Smith", "Dr. Kim Lee, Mr Kim Lee, Ms Kim Lee", "г-жа Анна Петрова и г-н Петров", "Mr " + "A.B." * 3000,
    "366-555-9807 or +1 366-555-9807", "token=0641917ea4e9feb9cda83477b57ac2654884f485, 0641917ea4e9feb9cda83477b57ac2654884f485",
    "3782 822463 10005 and 378282246310005; 2223003122003222", "2001:db8::ff00:42:8329 = 2001:0db8:0:0:0:ff00:42:8329; 12:30:45 a::b",
    "x@münchen.de and y@mail.example.com请", "Smith without a title"]


def test_spark_replaces_as_plain_python(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()] + NAMED + [None, ""]
    want, names = plainly(texts)
    assert replaced(spark, texts) == want
    assert len(set((k, new) for (k, _), new in names.items())) == len(names) and not {(k, new) for (k, _), new in names.items()} & set(names)
    assert sum(n for _, n in want) > 50


def test_whole_names_get_one_surrogate_per_word(spark):
    out = [t for t, _ in replaced(spark, NAMED)]
    first = re.fullmatch(r"Señora (\w+) (\w+) (\w+) (\w+) came\. (\w+) left\.", out[0])
    assert first and first[3] == first[5] and not set(first.groups()) & {"Ana", "María", "López", "García"}
    second = re.fullmatch(r"Dr\. ([A-Z])\. (\w+) and Mr (\w+) (\w+), then (\w+); (\w+) too, not Johnson\.", out[1])
    assert second and second[2] == second[4] == second[5] != "Smith" and second[3] == second[6] != "John" and second[1] != "J"
    third = re.fullmatch(r"Mr O'(\w+), Mr\. ([A-Z])\. ([A-Z])\. ([A-Z])\. (\w+); Ms (\w+)-(\w+) (\w+)", out[2])
    assert third and third[2] == second[1] and third[3] == third[4] != third[2] and third[8] == second[2]
    assert re.fullmatch(r"Ms \w+ de la \w+ saw Prof\. Dr\. \w+ \w+-\w+\.", out[3])
    assert not re.search("Maria|Cruz|Anna|Schmidt|Müller", out[3])
    five = re.fullmatch(r"Dr (\w+) (\w+) is Mr (\w+) (\w+)", out[5])
    assert five and five[1] == five[3] and five[2] == five[4] == second[2]
    six = re.fullmatch(r"Dr\. (\w+ \w+), Mr (\w+ \w+), Ms (\w+ \w+)", out[6])
    assert six and six[1] == six[2] == six[3] and six[1].split()[0][-2:] in ("el", "is")
    assert out[14] == NAMED[14]


def test_scripts_and_formats_stay(spark):
    out = [t for t, _ in replaced(spark, NAMED)]
    for old, new in ((NAMED[4], out[4]), (NAMED[7], out[7])):
        script = lambda text: {unicodedata.name(c).split()[0] for c in text if c.isalpha()}
        assert script(old) == script(new) and old != new
    assert not set("王伟") & set(out[4])
    phone = re.fullmatch(r"(\d{3}-\d{3}-\d{4}) or \+1 (\d{3}-\d{3}-\d{4})", out[9])
    assert phone and phone[1] == phone[2] != "366-555-9807"
    secret = re.fullmatch(r"token=([0-9a-f]{40}), ([0-9a-f]{40})", out[10])
    assert secret and secret[1] == secret[2] and secret[1] not in NAMED[10]
    card = re.fullmatch(r"(3\d{3} \d{6} \d{5}) and (3\d{14}); (2\d{15})", out[11])
    assert card and card[1].replace(" ", "") == card[2] != "378282246310005" and all(pii._luhn_sum(c) % 10 == 0 for c in (card[2], card[3]))
    ip = re.fullmatch(r"(\S+) = (\S+); 12:30:45 a::b", out[12])
    assert ip and "::" in ip[1] and "::" not in ip[2] and "ff00:42" not in out[12]
    assert re.fullmatch(r"\S+@\w{7}\.de and \S+@\w{4}\.\w{7}\.com请", out[13]) and "münchen" not in out[13]


@pytest.mark.parametrize("text", ["Mr " + "A.B." * 50_000, "a" * 300_000, "a:" * 100_000, "Ms " + "Ann " * 50_000, "x@" + "a" * 200_000, "Mr de " * 40_000])
def test_long_texts_are_read_in_linear_time(text):
    pii.replace_entities(text, {}, b"k")


def test_initials_are_a_cycle_without_fixed_letters():
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    new = [pii.initial_of(c, b"k") for c in letters]
    assert sorted(new) == list(letters) and all(a != b for a, b in zip(letters, new))


def test_nothing_in_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kind string, gender string")
    assert pii.replace_pii(docs, KEY).collect() == [] and pii.replace_pii(docs.filter(F.lit(False)), KEY).columns == docs.columns
