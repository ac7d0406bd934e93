"""Rules on given values, and what they must give."""

import datetime

import pytest
from pyspark.sql import functions as F

from marketloom.functions import attributes as A
from marketloom.functions import scoring as S
from marketloom.functions import texts as X
from marketloom.functions import titles as T
from marketloom.operators import alerts, delivery

FENCE = "```"
C = F.col
NAMES = "quality time verdicts texts replies specifics titles memory drives money".split() + ["other keys"]


def cases():
    """Schema of the given values, rules, and pairs of given and wanted values. Columns need a session."""
    RAM = {c: C(c) for c in ("generation", "ecc", "capacity_gb", "speed_mhz")} | {"registered": C("ecc")}
    DRIVE = {c: C(c) for c in ("interface", "form_factor", "capacity", "type", "rpm")}
    NAMED = {c: C(c) for c in ("manufacturer", "model", "drive_form_factor", "tier", "family", "vendor", "line", "speed", "port_type")} | {"port_count": C("n"), "vram_gb": C("n")}

    return {
        "quality": ("images boolean, specifics boolean, said int", [S.quality_score(C("images"), C("specifics"), C("said"))], [
            ((True, True, 501), (100.0,)), ((True, True, 0), (70.0,)), ((True, False, 50), (40.0,)), ((False, True, 0), (30.0,)), ((False, False, 201), (20.0,)), ((False, False, 50), (0.0,)), ((True, True, 51), (80.0,))]),
        "time": ("auction boolean, soon boolean, new boolean", [S.time_score(C("auction"), C("soon"), C("new"))], [
            ((True, True, True), (100.0,)), ((True, False, True), (80.0,)), ((True, False, False), (30.0,)), ((False, True, True), (80.0,)), ((False, True, False), (30.0,))]),
        "verdicts": ("score double", [delivery.report_verdict(C("score")), alerts.verdict(C("score"))], [
            ((0.3,), ("noise", "edge")), ((0.33,), ("edge", "edge")), ((0.65,), ("edge", "edge")), ((0.66,), ("deal", "edge")), ((0.7,), ("deal", "deal")), ((0.29,), ("noise", "noise"))]),
        "texts": ("x string, base string, trace string", [X.shortened(C("x"), 5), X.shortened_bytes(C("x"), 5), X.trace_url(C("base"), C("trace"))], [
            (("abc", "", "t1"), ("abc", "abc", "")), (("abcdefgh", "http://h/", "t1"), ("abcde…", "abcde...", "http://h/trace/t1")), (("", "http://h", None), ("", "", ""))]),
        "replies": ("reply string", [X.unfenced(C("reply")), X.parsed_verdict(C("reply"))["score"]], [
            ((f'{FENCE}json\n{{"a": 1}}\n{FENCE}',), ('{"a": 1}', 0.0)), ((' {"score": 0.5} ',), ('{"score": 0.5}', 0.5)), ((f"{FENCE}x{FENCE}",), ("x", None)), (('{"score": 2}',), ('{"score": 2}', None)), (("{}",), ("{}", 0.0))]),
        "specifics": ("x map<string,string>", [X.system_of(C("x")), X.specifics_text(C("x"))], [
            (({"Series": "Precision", "Form Factor": "Tower"},), ("workstation", "Form Factor: Tower, Series: Precision")), (({"Series": "OptiPlex"},), ("desktop", "Series: OptiPlex")), (({},), ("", "N/A")),
            (({"Most Suitable For": "Workstation"},), ("workstation", "Most Suitable For: Workstation")), (({"Product Line": "Pro", "Type": "Tower"},), ("desktop", "Product Line: Pro, Type: Tower"))]),
        "titles": ("t string", [T.server_tier(C("t")), T.accessory_only(C("t")), T.system_type(C("t")), T.title_speed(C("t"))], [
            (("PowerEdge R740 CTO",), ("barebone", False, "", None)), (("PowerEdge Xeon Gold 6130 64GB DDR4 PC4-21300V",), ("configured", False, "", 2666)), (("R740xd 24 bay backplane",), ("partial", True, "", None)),
            (("GPU riser cable",), ("partial", True, "", None)), (("DDR4-2933 PC4-23466",), ("partial", False, "", 2933)), (("drive caddy tray",), ("partial", True, "", None)),
            (("ThinkStation P920 Gold 6148",), ("partial", False, "workstation", None)), (("OptiPlex 7060 i5-8500",), ("partial", False, "desktop", None))]),
        "memory": ("generation string, ecc boolean, capacity_gb int, speed_mhz int, raw string, module string", [A.product_key(F.lit("ram"), RAM), T.condition(C("raw")), T.module_speed(C("module"))], [
            (("DDR4", True, 32, 2666, " Brand New ", "pc4-19200T"), ("ram:ddr4:ecc_reg:32gb:2666", "new", 2400)), (("DDR4", True, 32, None, "AS-IS\t", "25600\n"), ("ram:ddr4:ecc_reg:32gb:0", "for_parts", 3200)),
            ((None, None, None, None, "Refurbished", "PC5-1"), ("ram:unknown:unknown:0gb:0", "unknown", None))]),
        "drives": ("interface string, form_factor string, capacity string, type string, rpm int, said string", [A.product_key(F.lit("drive"), DRIVE), A.drive_kind(C("type"), C("rpm")), X.harmless(C("said"))], [
            (("SAS", "2.5", "1.2TB", "HDD", 10000, "a\tb"), ("drive:sas:2.5:1.2tb:10k", "10k", "a\tb")), (("NVMe", "U.2", "960GB", "SSD", None, "a\x07b"), ("drive:nvme:u.2:960gb:ssd", "ssd", "ab")),
            ((None, None, None, None, None, ""), ("drive:unknown:unknown:unknown:unknown", "unknown", "")), (("SATA", "3.5", "4TB", "HDD", 7200, "x"), ("drive:sata:3.5:4tb:7k2", "7k2", "x")),
            (("SAS", "3.5", "4TB", "HDD", 5900, "x"), ("drive:sas:3.5:4tb:hdd", "hdd", "x"))]),
        "other keys": ("manufacturer string, model string, drive_form_factor string, tier string, family string, vendor string, line string, speed string, port_type string, n int",
            [A.product_key(F.lit(k), NAMED) for k in ("server", "cpu", "nic", "gpu", "workstation", "desktop", "tape")], [
            (("Dell", "R740xd", "SFF", "partial", "Xeon", "dell", "precision", "25GbE", "SFP28", 2), ("server:dell:r740xd:sff:partial", "cpu:dell:xeon:r740xd", "nic:25gbe:2p:sfp28", "gpu:dell:xeon:r740xd:2gb", "workstation:dell:precision:r740xd", "desktop:dell:precision:r740xd", "other:tape")),
            ((None, "Gold 6130", "", None, None, None, None, None, None, None), ("server:unknown:gold_6130:unknown:unknown", "cpu:unknown:unknown:gold_6130", "nic:unknown:0p:unknown", "gpu:unknown:unknown:gold_6130:0gb", "workstation:unknown:unknown:gold_6130", "desktop:unknown:unknown:gold_6130", "other:tape"))]),
        "money": ("epoch decimal(20,6), x double, y double", [X.whole_seconds(C("epoch")), X.dollars(C("x")), X.plain_money(C("y"))], [
            (("1.5", 12.5, 7.0), (datetime.datetime(1970, 1, 1, 0, 0, 1, 500000), "$12.50", "7.00")), (("1000000000.000001", 0.01, 0.1), (datetime.datetime(2001, 9, 9, 1, 46, 40, 1), "$0.01", "0.10"))]),
    }


@pytest.mark.parametrize("name", NAMES)
def test_literals(spark, name):
    from decimal import Decimal

    schema, rules, pairs = cases()[name]
    rows = [(*(Decimal(v) if name == "money" and i == 0 else v for i, v in enumerate(given)), k) for k, (given, _) in enumerate(pairs)]
    found = spark.createDataFrame(rows, f"{schema}, k int").orderBy("k").select(*[r.alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    assert [tuple(r) for r in found] == [tuple(wanted) for _, wanted in pairs]
