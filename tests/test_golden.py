import json

from marketloom.sources.golden import annotated, golden


def test_items_and_answers(spark, tmp_path):
    at = tmp_path / "golden.json"
    at.write_text(json.dumps([{"title": "16GB RDIMM", "expected_component": "ram"}, {"title": "a box", "expected_component": "server"}, {"title": None}]))
    items = golden(spark, str(at))
    answers = spark.createDataFrame([("16GB RDIMM", "ram", 1)], "title string, component_type string, extra int")
    assert sorted((str(r.title), r.correct) for r in annotated(items, answers).collect()) == [("16GB RDIMM", True), ("None", False), ("a box", False)]


def test_missing_file_is_empty(spark, tmp_path):
    assert golden(spark, str(tmp_path / "none.json")).count() == 0
