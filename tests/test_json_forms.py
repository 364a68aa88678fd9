"""Canonical JSON and pruned plans on literal texts."""

import json

from sondage.operators import json_forms


def _one(spark, form, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, j string")
    return [r.x for r in rows.select("id", form(rows.j).alias("x")).orderBy("id").collect()]


def test_digest_knows_trees_not_texts(spark):
    a, b, c, d, e = _one(spark, json_forms.params_digest, ['{"b": [1, {"y": 2, "x": "é"}], "a": null}', '{"a":null,"b":[1,{"x":"é","y":2}]}', '{"a":null,"b":[{"x":"é","y":2},1]}', "no {", None])
    assert a == b and a != c and len(a) == len(d) == 15 and e is None


def test_plan_keeps_what_can_be_read(spark):
    node = {"id": 0, "parentId": None, "cost": 1.5, "operation": "SCAN", "other": {"id": 9}, "accessPredicates": "", "filterPredicates": "p" * 201}
    got = _one(spark, json_forms.pruned_plan, [json.dumps([node, {"depth": "2", "accessPredicates": 7}]), "[]", "{}", "no", None])
    assert json.loads(got[0]) == [{"id": 0, "cost": 1.5, "operation": "SCAN", "filterPredicates": "p" * 200 + "…"}, {"depth": "2"}]
    assert got[1:] == ["[]", None, None, None]
