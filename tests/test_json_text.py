import json
import math
import random
import struct

from pyspark.sql import functions as F

from feedfold.functions import json_text
from feedfold.operators import entries


def canonical(text):
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (ValueError, TypeError):
        return None


def written(spark, texts):
    json_text.allow_repeated_keys(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r.y for r in df.select("i", json_text.canonical_json("x").alias("y")).orderBy("i").collect()]


def test_payloads(spark):
    texts = [
        '{"b": 1.0, "a": [1e5, 1E-7, 1.50, -0.0, -0, 0.0001, 0.00001, 1e16, 1e15, 123456789012345678, 1.7976931348623157e308]}',
        '{"a": 1, "a": 2.50, "z": {"k": 1, "j": 0.1, "k": "last"}}', '{"a": {"c": [], "b": {}}, "": null, "A": true}',
        '{"n": 12345678901234567890123456789012345678901234567890, "m": -1234567890123456789}', '1.0', '"1.0"', ' [1.0 , 2] ',
        '{"t": "rated 4.5, then: 1e5", "q": "a\\"b: 1.5", "u": "\\u00e9\\u000b\\u001F\\u007f\\ud83d\\ude00", "s": "\\\\u000B"}',
        '{"x": NaN, "y": [Infinity, -Infinity], "z": 1e400, "w": -1e999}', '{"x": -NaN}', '{"x": +1.5}', '{"x": .5}', '{"x": 1.}',
        '{"x": 01.5}', '{1.5: 2}', '{NaN: 1}', '{"x": 1.5', '{"x": "1.5', '{"x": "1.5\\', '{"x" 1.5}', '[1.5 2.5]', '[1.5,]',
        '[1.5]x', '1.5e', '', None, 'null', 'true', '{"a":1.5}{"b":2}', '1}', '1,"b":2', '1,"b":2}', '{"a":1}]', '[1],[2', ' ', '{"v": "1.2.3", "d": "2026-06-25T10:00:00.5"}',
        '{"12345678901234567890": 1.5, "2.5": [[[[0.30000000000000004]]]]}', '{"long": "' + "x\\n" * 200_000 + '", "f": 2.50}']
    got = written(spark, texts)
    assert got == [canonical(t) for t in texts]
    assert sum(g is not None for g in got) == 14


def test_random_floats(spark):
    draw = random.Random(5)
    numbers = [struct.unpack("<d", draw.randbytes(8))[0] for _ in range(3000)]
    numbers = [x for x in numbers if math.isfinite(x) and abs(x) > 2.3e-308]
    numbers += [draw.randrange(10 ** 9) / 10 ** draw.randrange(12) for _ in range(2000)] + [10.0 ** e for e in range(-300, 300)]
    texts = [draw.choice(["%r", "%.17g", "%.25e", "%.20E"]) % x for x in numbers]
    assert written(spark, [f'{{"x":{t}}}' for t in texts]) == [canonical(f'{{"x":{t}}}') for t in texts]


def test_mark_in_text(spark):
    text = f'{{"b":"{json_text.MARK}1.5{json_text.MARK}","a":1}}'
    assert written(spark, [text])[0].count(json_text.MARK) in (0, 2)
    assert written(spark, ["{}", "[]"]) == ["{}", "[]"]
    json_text.allow_repeated_keys(spark)
    assert spark.createDataFrame([], "x string").select(json_text.canonical_json("x")).collect() == []


def test_entries_with_numbers_and_repeated_keys(spark, make_pages):
    body = ('{"feed":{"entry":[{"id":{"label":"r1"},"im:rating":{"label":5.0},"im:voteCount":1e2,"title":{"x":1.50},'
            '"content":{"label":"first"},"content":{"label":"rated 4.5, 1.0"},"author":{"name":{"label":7}},'
            '"link":{"attributes":{"href":2.0}}}]}}')
    row = entries.extract_entries(make_pages([(1, 0, "a", 1, body)])).first()
    assert (row.rating_raw, row.vote_count_raw, row.body_raw, row.title_raw, row.author_label_raw, row.review_url_raw) == (
        "5.0", "100.0", "rated 4.5, 1.0", '{"x":1.5}', "7", "2.0")
    assert row.raw_record == canonical(json.dumps(json.loads(body)["feed"]["entry"][0]))
    facts = entries.page_facts(make_pages([(1, 0, "a", 1, body)])).first()
    assert facts.is_json and facts.entry_count == 1 and facts.review_ids == ["r1"]


def test_numbers_behind_blanks_and_numbers_in_texts(spark):
    texts = ['{"a":  \n 1.50, "b" :\t1e5,"c": [ 2.50 ,\r\n-3.50], "t": "costs 12.5, 1e5 NaN -1.50"}', " 1.50", "\n\n1.50", "\t -1.50 ", "-1.50",
             '{"t": "costs 12.50"}', '{"a": {"b":1.50}}', '"x" 1.50', '{"a" 1.50}', "[[1.50],[ 2.50]]"]
    assert written(spark, texts) == [canonical(t) for t in texts]
    held = spark.createDataFrame([(t,) for t in texts], "t string").filter(F.col("t").rlike(json_text._MAY_HOLD)).collect()
    assert len(held) == len(texts) - 3 and '{"t": "costs 12.50"}' not in {r.t for r in held}
