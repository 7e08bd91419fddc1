import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tallylog import model
from tallylog.functions.json_text import VARIANT_MAP, attribute_classes, attribute_json, attribute_map
from tallylog.functions.timestamps import iso_millis, parse_iso, parse_iso_text
from tallylog.operators.validation import batch_outcome, validate
from tallylog.sources.envelopes import bodies_from_kafka, explode_entries, parse_envelopes, read_bodies, read_body_lines

AS_OF = parse_iso_text("2024-02-01T00:00:00Z")
GOOD = {"timestamp": "2024-01-31T10:00:00Z", "level": "info", "service": "s", "message": "m"}


def run(spark, bodies):
    frame = spark.createDataFrame(list(enumerate(bodies)), "batch_id long, raw string")
    return validate(explode_entries(parse_envelopes(frame)), AS_OF)


def reasons(spark, entries):
    body = '{"logs":[' + ",".join(entries) + "]}"
    rows = run(spark, [body]).select("index", "reason").collect()
    return [row.reason for row in sorted(rows, key=lambda r: r["index"])]


def entry(drop=(), **changes):
    return json.dumps({k: v for k, v in {**GOOD, **changes}.items() if k not in drop})


CASES = [
    (entry(), None),
    ("5", model.NOT_AN_OBJECT),
    ("null", model.NOT_AN_OBJECT),
    ('"{}"', model.NOT_AN_OBJECT),
    ("[{}]", model.NOT_AN_OBJECT),
    ("{}", "timestamp is required"),
    (entry(timestamp=None), "Expected string, received null"),
    (entry(timestamp=5), "Expected string, received number"),
    (entry(timestamp=1.5e300), "Expected string, received number"),
    (entry(timestamp=""), "invalid timestamp: must be a valid ISO 8601 string"),
    (entry(timestamp="14:00"), "invalid timestamp: must be a valid ISO 8601 string"),
    (entry(timestamp="yesterday"), "invalid timestamp: must be a valid ISO 8601 string"),
    (entry(drop=["level"]), "level is required"),
    (entry(level=["info"]), "Expected string, received array"),
    (entry(level="critical"), "invalid level: 'critical'"),
    (entry(level=""), "invalid level: ''"),
    (entry(level="Info"), "invalid level: 'Info'"),
    (entry(drop=["service"]), "service is required"),
    (entry(service=False), "Expected string, received boolean"),
    (entry(service=""), "service must be a non-empty string"),
    (entry(service=" "), None),
    (entry(drop=["message"]), "message is required"),
    (entry(message={"a": 1}), "Expected string, received object"),
    (entry(message=""), "message must be a non-empty string"),
    (entry(attributes={}), None),
    (entry(attributes={"a": 1, "b": "x", "c": True}), None),
    (entry(attributes=None), "Expected object, received null"),
    (entry(attributes="x"), "Expected object, received string"),
    (entry(attributes=[]), "Expected object, received array"),
    (entry(attributes={"a": None}), "Invalid input"),
    (entry(attributes={"a": {}}), "Invalid input"),
    (entry(attributes={"a": 1, "b": []}), "Invalid input"),
    (entry(host="h"), "Unrecognized key(s) in object: 'host'"),
    (entry(zone="z", host="h"), "Unrecognized key(s) in object: 'zone', 'host'"),
    (entry(b=1, **{"10": 1, "9": 1}), "Unrecognized key(s) in object: '9', '10', 'b'"),
    # Two faults: the earlier rule speaks.
    (entry(timestamp="nope", level="critical"), "invalid timestamp: must be a valid ISO 8601 string"),
    (entry(drop=["timestamp"], level="critical"), "timestamp is required"),
    (entry(level="critical", service=""), "service must be a non-empty string"),
    (entry(service="", message=""), "service must be a non-empty string"),
    (entry(message="", attributes=[]), "message must be a non-empty string"),
    (entry(attributes={"a": None}, host="h"), "Invalid input"),
    (entry(level="critical", host="h"), "Unrecognized key(s) in object: 'host'"),
    (entry(timestamp="2030-01-01", level="critical"), "invalid level: 'critical'"),
    # Five minutes ahead is the last moment that is accepted.
    (entry(timestamp="2024-02-01T00:05:00.000Z"), None),
    (entry(timestamp="2024-02-01T00:05:00.0009Z"), None),
    (entry(timestamp="2024-02-01T00:05:00.001Z"), model.TIMESTAMP_FUTURE),
    ('{"level":"critical",' + entry()[1:], None),
    (entry()[:-1] + ',"level":"critical"}', "invalid level: 'critical'"),
]


def test_first_failing_rule_is_the_reason(spark):
    got = reasons(spark, [text for text, _ in CASES])
    assert [(t, r) for (t, _), r in zip(CASES, got)] == CASES


def test_refused_bodies(spark):
    good = '{"logs":[' + entry() + "]}"
    refused = [
        "not json",
        "",
        "[1,2]",
        "[" + good + "]",
        '{"x":1}',
        '{"logs":[]}',
        '{"logs":{}}',
        '{"logs":null}',
        '{"logs":"x"}',
        good[:-1],
        good + " x",
        good + "," + good,
        good + "],[",
        "{'logs':[1]}",
        '{"logs":[NaN]}',
        "5",
    ]
    accepted = [good, " \n" + good + "\n", good[:-1] + ',"other":[1]}']
    rows = batch_outcome(run(spark, refused + accepted)).collect()
    outcome = {row.batch_id: row for row in rows}
    for i in range(len(refused)):
        assert (outcome[i].outcome, outcome[i].error) == ("refused", model.REFUSED_BODY), refused[i]
        assert (outcome[i].accepted, outcome[i].rejected) == (0, 0)
    for i in range(len(refused), len(refused) + len(accepted)):
        assert (outcome[i].outcome, outcome[i].accepted, outcome[i].error) == ("accepted", 1, None)


def test_mixed_batch_and_batch_with_only_bad_entries(spark):
    bad = '{"level":"not-a-real-level","service":"x","message":"bad entry"}'
    bodies = ['{"logs":[' + entry() + "," + bad + "]}", '{"logs":[' + bad + "]}"]
    rows = {r.batch_id: r for r in batch_outcome(run(spark, bodies)).collect()}
    assert (rows[0].accepted, rows[0].rejected, rows[0].outcome) == (1, 1, "accepted")
    assert (rows[1].accepted, rows[1].rejected, rows[1].outcome) == (0, 1, "refused")
    assert reasons(spark, [entry(), bad]) == [None, "timestamp is required"]


def test_many_different_keys_in_one_body(spark):
    """Entries do not carry each other's key names."""
    entries = [entry(attributes={f"key_{i}_{j}": j for j in range(3)}) for i in range(3000)]
    frame = run(spark, ['{"logs":[' + ",".join(entries) + "]}"])
    assert frame.where("reason is null").count() == 3000
    sizes = frame.where("reason is null").select(F.max(F.length("attributes"))).first()[0]
    assert sizes < 100


NUMBERS = {
    # written: (text for filters, JSON)
    "3.0": ("3", "3"),
    "1e3": ("1000", "1000"),
    "0.1": ("0.1", "0.1"),
    "-0": ("0", "0"),
    "-0.0": ("0", "0"),
    "12.340": ("12.34", "12.34"),
    "9007199254740993": ("9007199254740992", "9007199254740992"),
    "999999999999999": ("999999999999999", "999999999999999"),
    "1e20": ("1" + "0" * 20, "1" + "0" * 20),
    "1e21": ("1" + "0" * 21, "1e+21"),
    "2e23": ("2" + "0" * 23, "2e+23"),
    "123456789012345680000": ("123456789012345680000", "123456789012345680000"),
    "0.000001": ("0.000001", "0.000001"),
    "1e-7": ("0.0000001", "1e-7"),
    "-1.5e-9": ("-0.0000000015", "-1.5e-9"),
    "0.00012345678901234567": ("0.00012345678901234567", "0.00012345678901234567"),
    "1e40": ("1" + "0" * 40, "1e+40"),
    "1e-30": ("0." + "0" * 29 + "1", "1e-30"),
    "1e400": (None, "null"),
    "0.30000000000000004": ("0.30000000000000004", "0.30000000000000004"),
    "-123.456e5": ("-12345600", "-12345600"),
}


def test_numbers(spark):
    texts = list(NUMBERS)
    body = "{" + ",".join(f'"n{i:02d}":{t}' for i, t in enumerate(texts)) + "}"
    parsed = (
        spark.createDataFrame([(body,)], "j string")
        .select(F.parse_json("j").alias("given"))
        .withColumn("values", F.try_variant_get("given", "$", VARIANT_MAP))
        .withColumn("classes", attribute_classes(F.col("values")))
    )
    columns = (F.col("given"), F.col("values"), F.col("classes"))
    row = parsed.select(
        attribute_map(*columns).alias("text"), attribute_json(*columns).alias("json")
    ).first()
    assert {t: row.text[f"n{i:02d}"] for i, t in enumerate(texts)} == {
        t: text for t, (text, _) in NUMBERS.items()
    }
    expected = ",".join(f'"n{i:02d}":{NUMBERS[t][1]}' for i, t in enumerate(texts))
    assert row.json == "{" + expected + "}"


def test_attribute_keys_and_strings(spark):
    attributes = {"a.b": 'q"\n', "q'k": True, 'd"q': "é", "z": "\\"}
    frame = run(spark, ['{"logs":[' + entry(attributes=attributes) + "]}"])
    row = frame.first()
    assert json.loads(row.attributes) == attributes
    assert row.attr == {"a.b": 'q"\n', "q'k": "true", 'd"q': "é", "z": "\\"}
    assert list(json.loads(row.attributes)) == sorted(attributes)


def test_plain_and_rewritten_attributes_look_alike(spark):
    """A number that must be written anew does not change how the others look."""
    plain = {"b": True, "i": -12, "s": 'é"\\\n/', "t": ""}
    frame = run(spark, ['{"logs":[' + entry(attributes=plain) + "," + entry(attributes={**plain, "z": 0.5}) + "]}"])
    first, second = frame.orderBy("index").collect()
    assert first.attributes[:-1] + ',"z":0.5}' == second.attributes
    assert {**first.attr, "z": "0.5"} == second.attr
    assert first.attr == {"b": "true", "i": "-12", "s": plain["s"], "t": ""}


ISO = {
    "2026-07-20T14:32:01.123456Z": "2026-07-20T14:32:01.123Z",
    "2026-07-20T14:32:01.9999999999Z": "2026-07-20T14:32:01.999Z",
    "2026-07-20T14:32:01.1Z": "2026-07-20T14:32:01.100Z",
    "2026-07-20T14:32:01+02:00": "2026-07-20T12:32:01.000Z",
    "2026-07-20T14:32:01-05:30": "2026-07-20T20:02:01.000Z",
    "2026-07-20T14:32:01": "2026-07-20T14:32:01.000Z",
    "2026-07-20T14:32Z": "2026-07-20T14:32:00.000Z",
    "2026-07-20T14:32+01:00": "2026-07-20T13:32:00.000Z",
    "2026-07-20": "2026-07-20T00:00:00.000Z",
    "2026-07": "2026-07-01T00:00:00.000Z",
    "2026": "2026-01-01T00:00:00.000Z",
    "2026-07-20T24:00:00Z": "2026-07-21T00:00:00.000Z",
    "2026-07-20T24:00:01Z": None,
    "2026-02-30": "2026-03-02T00:00:00.000Z",
    "2026-02-30T01:02:03Z": "2026-03-02T01:02:03.000Z",
    "2026-02-32": None,
    "2026-13-01": None,
    "2026-07-20T25:00Z": None,
    "2026-07-20T14": None,
    "2026-07-20 14:32:01": "2026-07-20T14:32:01.000Z",
    "2026-07-20t14:32:01z": "2026-07-20T14:32:01.000Z",
    "2026-07-20T14:32:01+0200": "2026-07-20T12:32:01.000Z",
    "2026-07-20T14:32:01.5-0530": "2026-07-20T20:02:01.500Z",
    "2026-07-20 14:32+02": "2026-07-20T12:32:00.000Z",
    "+002026-07-20T14:32:01Z": "2026-07-20T14:32:01.000Z",
    "2026-07-20  14:32:01": None,
    "2026-07-20T14:32:01+2": None,
    "2026-07-20T14:32:01 or so": None,
    "1969-12-31T23:59:59.9999Z": "1969-12-31T23:59:59.999Z",
    "14:00": None,
    "": None,
    "2026-07-20\n": None,
}


def test_iso_texts_in_spark_and_on_the_driver(spark):
    frame = spark.createDataFrame([(t,) for t in ISO], "t string")
    got = {r.t: r.iso for r in frame.select("t", iso_millis(parse_iso(F.col("t"))).alias("iso")).collect()}
    assert got == ISO

    def driver(text):
        moment = parse_iso_text(text)
        return moment and moment.isoformat(timespec="milliseconds").replace("+00:00", "Z")

    assert {t: driver(t) for t in ISO} == ISO


def test_ids_do_not_depend_on_the_run(spark):
    body = '{"logs":[' + entry() + "," + entry() + "]}"
    first = [r.id for r in run(spark, [body, body]).orderBy("batch_id", "index").collect()]
    again = [r.id for r in run(spark, [body, body]).repartition(3).orderBy("batch_id", "index").collect()]
    assert first == again and len(set(first)) == 4


def test_the_first_and_last_moments_do_not_raise():
    assert parse_iso_text("0000-01-01").year == parse_iso_text("0001-01-01T00:00:00+02:00").year == 1
    assert parse_iso_text("9999-12-31T23:59:59-02:00").year == 9999


FRAMES = {
    "trailing": '{"logs":[%s]} x',
    "second": '{"logs":[%s]},{"a":1}',
    "closed": '{"logs":[%s]}]',
    "quotes": "{'logs':[%s]}",
    "nan": '{"logs":[NaN,%s]}',
    "object": '{"logs":{"a":%s}}',
    "empty": '{"logs":[]}',
}


def test_refused_bodies(spark):
    bodies = [text.replace("%s", entry()) for text in FRAMES.values()] + ["[1]", "5", "null", "", "{}"]
    rows = run(spark, bodies).collect()
    assert len(rows) == len(bodies)
    assert {(r["index"], r.reason) for r in rows} == {(None, model.REFUSED_BODY)}


def test_a_string_that_looks_like_an_entry(spark):
    assert reasons(spark, [json.dumps(entry()), entry(), '"x"', '" {}"']) == [
        model.NOT_AN_OBJECT, None, model.NOT_AN_OBJECT, model.NOT_AN_OBJECT
    ]


def test_long_white_space_in_strings(spark):
    blank = json.dumps(" " * 200_000)
    assert reasons(spark, [blank, entry(), '"\\u0020\\u007b}"', '"\\n{}"']) == [
        model.NOT_AN_OBJECT, None, model.NOT_AN_OBJECT, model.NOT_AN_OBJECT
    ]


def test_an_odd_entry_leaves_the_others(spark):
    number, message = '{"a":' + "1" * 1200 + "}", entry(message="m" * 21_000_000)
    assert reasons(spark, [number, entry(), message, entry()]) == [model.ENTRY_LIMIT, None, model.ENTRY_LIMIT, None]


@pytest.mark.parametrize("odd", ['{"' + "k" * 60_000 + '":1}', '{"a":' + "[" * 1200 + "]" * 1200 + "}"])
def test_what_the_reader_cannot_take_is_called_so(spark, odd):
    row = run(spark, ['{"logs":[' + odd + "," + entry() + "]}"]).first()
    assert row["index"] is None and row.reason == model.BODY_LIMIT


def test_a_body_beyond_a_single_value(spark):
    n = 700_000
    listed = F.concat_ws(",", F.array_repeat(F.lit(entry(message="m" * 130)), n))
    body = spark.range(1).select(F.col("id").alias("batch_id"), F.concat(F.lit('{"logs":['), listed, F.lit("]}")).alias("raw"))
    assert body.select(F.length("raw")).first()[0] > 2**27
    counts = validate(explode_entries(parse_envelopes(body)), AS_OF).groupBy("reason").count().collect()
    assert [tuple(r) for r in counts] == [(None, n)]


def test_bodies_by_line(spark, tmp_path):
    (tmp_path / "many.jsonl").write_text("\n".join(['{"logs":[' + entry() + "]}", "", '{"logs":[' + entry() + "]}\r", "x"]))
    rows = validate(explode_entries(parse_envelopes(read_body_lines(spark, str(tmp_path)))), AS_OF).collect()
    named = {r.batch_id.rsplit("/", 1)[1]: r.reason for r in rows}
    assert named == {"many.jsonl#1": None, "many.jsonl#3": None, "many.jsonl#4": model.REFUSED_BODY}
    assert len({r.id for r in rows if r.id}) == 2


def test_sources(spark, tmp_path):
    pretty = json.dumps({"logs": [GOOD]}, indent=2)
    (tmp_path / "one.json").write_text(pretty)
    (tmp_path / "two.json").write_text('{"logs":[' + entry() + "]}")
    files = read_bodies(spark, str(tmp_path))
    rows = validate(explode_entries(parse_envelopes(files)), AS_OF).collect()
    assert [r.reason for r in rows] == [None, None]
    assert sorted(r.batch_id.rsplit("/", 1)[1] for r in rows) == ["one.json", "two.json"]

    records = spark.createDataFrame(
        [("logs", 3, 42, bytearray(b'{"logs":[]}'))],
        "topic string, partition int, offset long, value binary",
    )
    row = bodies_from_kafka(records).first()
    assert (row.batch_id, row.raw) == ("logs/3/42", '{"logs":[]}')


@pytest.mark.parametrize("minutes, reason", [(5, None), (6, model.TIMESTAMP_FUTURE)])
def test_future_limit_follows_as_of(spark, minutes, reason):
    late = (AS_OF + timedelta(minutes=minutes)).isoformat().replace("+00:00", "Z")
    assert reasons(spark, [entry(timestamp=late)]) == [reason]
