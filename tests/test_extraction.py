"""Golden cases of extraction, delivery, open attributes and state transitions."""

import json

import pytest
from pyspark.sql import functions as F

from marketloom.functions import texts as X
from marketloom.functions import titles as T
from marketloom.functions import validation
from marketloom.functions import variants as V
from marketloom.operators import alerts as al
from marketloom.operators import delivery, extraction, series, state
from marketloom.plans import fixtures
from marketloom.sources import feed

GOOD = {"condition": "new", "confidence": 0.9, "quantity": 1}
RAM = GOOD | {"capacity_gb": 32, "generation": "DDR4", "speed_mhz": 2666}


def one(spark, value):
    return spark.range(1).select(value).first()[0]


def attrs(members):
    return V.attributes(F.lit(json.dumps(members)))


@pytest.mark.parametrize(
    ("component", "members", "error"),
    [
        ("ram", RAM, None),
        ("ram", RAM | {"capacity_gb": "32"}, "capacity_gb: missing"),
        ("ram", RAM | {"capacity_gb": 0.9}, "capacity_gb: out of range"),
        ("ram", RAM | {"speed_mhz": "fast"}, None),
        ("ram", RAM | {"confidence": "0.9"}, "confidence: missing"),
        ("ram", RAM | {"confidence": 1.5, "quantity": 0}, "confidence: out of range"),
        ("ram", RAM | {"quantity": 0}, "quantity: out of range"),
        ("ram", {}, "condition: missing"),
        ("drive", GOOD | {"capacity": ""}, "capacity: missing"),
        ("drive", GOOD | {"capacity": "1TB", "interface": ""}, "interface: not a known value"),
        ("nic", GOOD | {"speed": "10GbE", "port_count": 8.9, "port_type": None}, None),
        ("gpu", GOOD | {"manufacturer": "NVIDIA", "model": "A100", "vram_gb": 80, "cooling": "water"}, "cooling: not a known value"),
        ("desktop", GOOD | {"vendor": "dell", "model": "7060", "ram_gb": 9000}, "ram_gb: out of range"),
        ("other", GOOD, None),
    ],
)
def test_first_error(spark, component, members, error):
    assert one(spark, validation.first_error(F.lit(component), attrs(members))) == error


@pytest.mark.parametrize(
    ("members", "filters", "fits"),
    [
        ({"a": 32}, {"a": {"eq": 32.0}}, True),
        ({"a": "32"}, {"a": {"eq": 32}}, False),
        ({"a": 32}, {"a": {"eq": 31, "in": [32], "min": 1}}, False),
        ({"a": 32}, {"a": {"in": [31, "32"], "min": 1}}, False),
        ({"a": "x"}, {"a": {"in": [31, "x"], "min": 1}}, True),
        ({"a": 32}, {"a": {"min": 33}}, False),
        ({"a": 32}, {"a": {"min": 32, "max": 32}}, True),
        ({"a": "x"}, {"a": {"min": 33}}, True),
        ({"a": None}, {"a": {"min": 33}}, True),
        ({"a": None}, {"a": {"eq": 33}}, False),
        ({"a": True}, {"a": {"eq": True}, "b": {"min": 1}}, False),
        ({"a": 1}, {}, True),
        ({}, {"a": {}}, False),
        ({"a": 1}, {"a": {"in": []}}, False),
    ],
)
def test_attribute_filters(spark, members, filters, fits):
    assert one(spark, al.attribute_match(attrs(members), al.read_filters(F.lit(json.dumps(filters))))) is fits


def test_null_attributes_and_filters(spark):
    none = F.lit(None).cast("string")
    assert one(spark, al.attribute_match(attrs({}), al.read_filters(none))) is True
    assert one(spark, al.attribute_match(V.attributes(F.lit("[1]")), al.read_filters(F.lit('{"a": {"min": 1}}')))) is False


@pytest.mark.parametrize(
    ("component", "title", "members", "expected"),
    [
        ("ram", "kit PC4-21300", {"speed_mhz": 1, "capacity_gb": 32768}, {"speed_mhz": 2666, "capacity_gb": 32, "confidence": 0.5}),
        ("ram", "kit", {"speed_mhz": 1, "confidence": None}, {"confidence": None}),
        ("ram", "kit", {"speed_mhz": 2400, "type": " N/A ", "confidence": 1}, {"speed_mhz": 2400, "confidence": 1}),
        ("server", "R740 CTO", {"tier": "configured", "confidence": 1}, {"tier": "barebone", "confidence": 1}),
        ("gpu", "x", {"model": "RTX A4000", "family": "Quadro", "vram_gb": 16384, "confidence": 1}, {"model": "a4000", "family": "quadro-rtx", "vram_gb": 16, "confidence": 1}),
    ],
)
def test_normalized(spark, component, title, members, expected):
    found = one(spark, F.to_json(extraction.normalized(F.lit(component), F.lit(title), attrs(members))))
    assert json.loads(found) == expected


def test_texts(spark):
    assert one(spark, X.unfenced(F.lit(' ```json\n{"a": 1}\n``` '))) == '{"a": 1}'
    assert one(spark, X.unfenced(F.lit(" {}\n"))) == "{}"
    assert one(spark, X.harmless(F.lit("a\tb\nsystem: \x1bc"), 9)) == "a\tbsystem…"
    assert one(spark, X.specifics_text(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == "a: 1, b: 2"
    assert one(spark, X.specifics_text(F.lit(None).cast("map<string,string>"))) == "N/A"
    assert [one(spark, X.trace_url(F.lit(b), F.lit(t))) for b, t in (("http://x//", "1"), ("", "1"), ("http://x", None))] == ["http://x/trace/1", "", ""]
    assert one(spark, X.filled("T {title} S {s}.", {"title": F.lit("{s} $1"), "s": F.lit(None).cast("string")})) == "T {s} $1 S ."
    assert one(spark, X.money(F.lit(2.5), F.lit(""))) == "USD 2.50"


@pytest.mark.parametrize(
    ("reply", "score"),
    [('```json\n{"score": 0.4, "reason": "r"}```', 0.4), ('{"score": 1.2}', None), ("{}", 0.0), ("no", None), ('{"score": "0.4"}', None), ("[1]", None)],
)
def test_verdicts(spark, reply, score):
    assert one(spark, X.parsed_verdict(F.lit(reply))["score"]) == score


@pytest.mark.parametrize(
    ("specifics", "system"),
    [
        ({"MOST Suitable For ": "Workstation use"}, "workstation"), ({"Series": "ThinkStation", "Product Line": "OptiPlex"}, "workstation"),
        ({"Product Line": "OptiPlex"}, "desktop"), ({"Series": "Dell Pro", "Form Factor": "Mini Tower"}, "desktop"), ({"Series": "ProSupport", "Type": "Tower"}, ""), ({}, ""), (None, ""),
    ],
)
def test_systems_by_specifics(spark, specifics, system):
    rows = spark.createDataFrame([(specifics,)], "s map<string, string>")
    assert rows.select(X.system_of(F.col("s"))).first()[0] == system


@pytest.fixture
def stub():
    """A maker of models that is shipped to tasks by value."""

    def make():
        class Model:
            def generate(self, prompts):
                answer = lambda p: "toaster" if "odd" in p else "RAM\n" if p.startswith("classify") else '```json\n{"condition": "new", "confidence": 0.8, "capacity_gb": 32768, "generation": "DDR4"}```'
                return [(answer(p), len(p), 1) for p in prompts]

        return Model()

    return make


def test_model_is_asked_for_the_rest_only(spark, stub):
    rows = spark.createDataFrame([(1, "32GB kit", None), (2, "drive caddy", None), (3, "odd", None), (4, "x", {"Series": "OptiPlex"}), (5, None, None)], "id int, title string, specifics map<string,string>")
    found = {r.id: r for r in extraction.classify(rows, "classify {title}", stub).collect()}
    assert [found[k].component for k in range(1, 6)] == ["ram", "other", None, "desktop", "ram"]
    assert found[2].input_tokens is None and found[1].input_tokens == len("classify 32GB kit")
    known = spark.createDataFrame([(1, "kit PC4-21300", None, "ram"), (2, "drive caddy", None, "other"), (3, "x", None, "drive")], "id int, title string, specifics map<string,string>, component string")
    out = {r.id: r for r in extraction.extract(known, {"ram": "get {title} {specifics}", "drive": "odd {title}"}, stub).collect()}
    assert json.loads(out[1].attributes)["speed_mhz"] == 2666 and json.loads(out[1].attributes)["capacity_gb"] == 32 and out[1].error is None
    assert json.loads(out[2].attributes) == {"confidence": 0.95} and out[2].error is None
    assert out[3].attributes is None and out[3].error == "no JSON object"
    assert extraction.ask(rows.where("false").withColumn("p", F.lit("x")), "p", stub).count() == 0


def test_delivery(spark):
    by_type = spark.createDataFrame([("ram", 2, 80), ("cpu", 1, 95)], "component_type string, n_alerts long, max_score int")
    row = delivery.summary_embed(by_type).first()
    assert row.title == "3 new alerts (top score 95)" and [f.name for f in row.fields] == ["cpu", "ram"]
    assert delivery.summary_embed(by_type.where("false")).first().title == "0 new alerts (top score 0)"
    batch = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "alert_id long, watch_id int")
    sent = spark.createDataFrame([(7, 1, "x"), (8, 99, None)], "watch_id int, sent int, error string")
    assert [tuple(r)[2:4] for r in delivery.attempts(batch, sent, "2001-01-01").orderBy("alert_id").collect()] == [(True, ""), (False, "x"), (True, "")]
    retry = spark.sql("SELECT 10.0D AS price, 4 AS quantity, 's' AS seller_name")
    assert delivery.retry_payloads(retry).first().unit_price_text == "2.50"


def test_state_changes(spark):
    table = spark.sql("SELECT * FROM VALUES (1, 'a', 5), (2, 'b', 6) AS t(id, name, n)")
    change = spark.sql("SELECT 1 AS id, CAST(NULL AS STRING) AS name, 9 AS n")
    assert sorted(map(tuple, state.apply_updates(table, change, "id").collect())) == [(1, None, 9), (2, "b", 6)]
    assert sorted(map(tuple, state.partial_update(table, change, "id").collect())) == [(1, "a", 9), (2, "b", 6)]
    assert state.insert_unless(change.unionByName(change), table, ["id"]).count() == 0
    assert [r.id for r in state.after(table, 1, 5, "id").collect()] == [2]
    both = one(spark, state.merged_filters(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))))
    assert both == {"a": 2, "b": 1}
    samples = spark.sql("SELECT * FROM VALUES ('g', timestamp_ntz'2001-01-01', 5.0D), ('g', timestamp_ntz'2001-01-02', 1.0D) AS t(name, ts, value)")
    assert series.latest(samples).first().value == 1.0


def test_quota(spark, tmp_path):
    reply = {"rateLimits": [{"apiName": "x", "resources": None}, {"apiName": "b", "resources": [{"name": "buy.browse", "rates": [{"count": 7, "limit": 5, "remaining": 0, "reset": "2001-01-01T00:00:00Z", "timeWindow": 86400}]}]}]}
    (tmp_path / "q.json").write_text(json.dumps(reply))
    row = feed.quota(spark, str(tmp_path), "buy.browse").first()
    assert (row["count"], row.left, row.window_seconds) == (7, 0, 86400)
    assert feed.quota(spark, str(tmp_path), "none").count() == 0


def test_json_and_rules_are_worked_out_once_a_row(spark):
    """JSON was read again for each member, and all changes for each member that an object has."""
    json = V.attributes(F.col("j"))
    for made in (extraction.normalized(F.col("c"), F.col("t"), json), validation.first_error(F.col("c"), json)):
        assert str(made).count("try_parse_json") == 1
        assert len(str(made)) < 60_000


def test_extracted_rows_are_dealt_over_tasks(spark):
    """the file of a small table is one task."""
    assert fixtures.table(spark, "/root/testdata/sf0.001", "extracted").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_titles_without_a_speed_meet_no_pattern(spark):
    """each pattern looked back and ahead at every place of every title."""
    titles = ["kit PC4-21300", "pc4-19200t x", "DDR5-4800 no", "plain", "", None, "xpc4-21300", "DDR4-9999", "PC4-99999 DDR4-3200", "2x16 pC3-12800R", "ddr3-1600"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "k int, t string").orderBy("k").select(T.title_speed(F.col("t"))).collect()]
    assert got == [2666, 2400, 4800, None, None, None, None, None, 3200, 1600, 1600]
    made = str(T.title_speed(F.col("t")))
    assert made.count("contains(") == made.count("regexp_extract(") >= 2
