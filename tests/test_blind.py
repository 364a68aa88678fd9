"""The blind filter on literal trees."""

import hashlib
import json

import pytest

from sondage.operators import blind

opaque = lambda s: "opaque-" + hashlib.sha256(s.encode()).hexdigest()[:24]


@pytest.mark.parametrize(("given", "clean", "counts"), [
    ('{"b": 1.50, "a": [true, null, "x"]}', '{"a":[true,null,"x"],"b":1.50}', (0, 0, 0)),
    ('{"CASE_ID": {"golden": 1}, "a": {"golden": [1]}}', '{"a":{}}', (2, 0, 0)),
    ('["run scenario-a.b_1 of F01-X", "F01-Xé"]', f'["run {opaque("scenario-a.b_1")} of {opaque("F01-X")}","{opaque("F01-X")}é"]', (0, 0, 3)),
    ('["command=inject now", "inject now", "sudo ls", "see scenario-runs"]', f'["{blind.WITHHELD}","inject now","sudo ls","{blind.WITHHELD}"]', (0, 2, 0)),
    (json.dumps({"raw": ' {"case_id": 1, "k": "case-7"} '}), json.dumps({"raw": '{"k":"%s"}' % opaque("case-7")}, separators=(",", ":")), (1, 0, 1)),
    ('{"raw": "{broken case-7"}', '{"raw":"{broken %s"}' % opaque("case-7"), (0, 0, 1)),
    ('{"case-7": 12345678901234567890123}', '{"%s":12345678901234567890123}' % opaque("case-7"), (0, 0, 1)),
    ('"\\ud800"', '"�"', (0, 0, 0)),
    ("{} {}", None, (0, 0, 0)), ("NaN", None, (0, 0, 0)), ("", None, (0, 0, 0)), (None, None, (0, 0, 0)),
    ("[" * 100_000, None, (0, 0, 0)),
])
def test_trees(given, clean, counts):
    assert blind.filtered(given) == (clean, *counts)


@pytest.mark.parametrize(("around", "entered"), [(63, True), (64, False)])
def test_embedded_json_is_entered_down_to_64_levels(around, entered):
    clean, removed, _, _ = blind.filtered("[" * around + json.dumps('{"golden": 1}') + "]" * around)
    assert removed == int(entered) and clean == "[" * around + json.dumps("{}" if entered else '{"golden": 1}') + "]" * around


def test_column(spark):
    rows = spark.createDataFrame([(1, '{"case_id": 1}'), (2, None), (3, "no")], "id long, j string")
    got = rows.select("id", blind.blind_json(rows.j).alias("b")).select("id", "b.*").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "{}", 1, 0, 0), (2, None, 0, 0, 0), (3, None, 0, 0, 0)]
