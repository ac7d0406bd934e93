"""URL filters, vector codes and phrases against plain versions, on odd rows and by parts."""

import random
import threading
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain_import import plain
from pyspark.sql import functions as F

from marketloom.llm import collocations, common, link_graph, vector_codes


def all_rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


HOSTS = [f"{a}.{b}" for a in ("a", "b", "www.c", "d.e", "example") for b in ("com", "net", "org", "example.com")] + ["org", "com", "xcom", "WWW.Example.COM", "h:80", "u@h.net"]


def linked_pages(seed=2, n=400):
    r = random.Random(seed)
    pages = []
    for k in range(n):
        href = lambda: r.choice(['<a href="https://{}/x">', "<A HREF=//{}>", "<a href = 'http://{}?q'>", '<a href="/{}">', "<link\nhref=HTTPS://{}/>", '<a data="//{}">', "<a xhref=//{}>"]).format(r.choice(HOSTS))
        html = r.choice([None, "", "".join(href() for _ in range(r.randint(1, 4)))])
        host = r.choice(HOSTS)
        paths = ["/es/1", "/fr/2", "/es/?x", "/de/3"] if host.endswith("net") else ["", "/", "/en/", "/en/x?y#z", "/es/1", "/fr/2", "/de/3", "?a/en/", "#/es/"]
        url = f"http{r.choice(['', 's'])}://{host}{r.choice(paths)}"
        pages.append((k, url, html))
    pages += [(1, None, "<a href=//a.com>"), (2, "no scheme", None), (3, "://", ""), (4, "x:///en/", None), (None, "http://a.com/é/\n", None), (5, "a://b.com://c.net/es/", None), (5, "a://b.com://c.net/es/", None)]
    return pages


COLUMNS = ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]


@pytest.mark.parametrize("bound", [None, 0])
def test_urls(spark, monkeypatch, bound):
    hub = 100_000
    if bound is not None:  # all joins by shuffle, hosts of more than three edges dealt
        monkeypatch.setattr(link_graph, "BROADCAST_HOSTS", 0)
        hub = 3
    rows = linked_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).repartition(3)
    found = all_rows(link_graph.judged_urls(pages, hub_edges=hub), *COLUMNS)
    expected = plain.url_verdicts(rows)
    assert found == Counter(expected)
    assert len({x[4:] for x in expected}) > 20 and {x[4] for x in expected if x[3] is None} == {"allow", "block"}


def test_what_links_to_blocked_hosts_is_blocked(spark):
    pages = [(k, "http://bad.net/es/1", None) for k in range(3)] + [(10, "http://ok.com/", '<a href="http://good.org/">')]
    pages += [(20, "http://farm.org/", '<a href="http://bad.net/">'), (21, "http://farm2.org/", "<a href=http://farm.org/>"), (22, "http://good.org/", None), (23, "http://none.org/", None), (24, "http://bad.net/en/", None)]
    found = {r.page_id: r.verdict for r in link_graph.judged_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k: found[k] for k in (20, 21, 22, 23, 24)} == {20: "block", 21: "block", 22: "allow", 23: "allow", 24: "block"}


@pytest.mark.parametrize("seed", range(3))
def test_tree_finds_what_a_full_search_finds(seed):
    r = np.random.default_rng(seed)
    for dtype, width in ((np.int64, 8), (object, 3), (np.int64, 1), (np.int64, 0)):
        entries = r.integers(-3, 4, (r.integers(1, 40), width)).astype(dtype)
        x = r.integers(-4, 5, (300, width)).astype(dtype)
        index, best = vector_codes.Tree(entries).nearest(x)
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert index.tolist() == [row.tolist().index(min(row.tolist())) for row in d]
        assert best.tolist() == d.min(axis=1).tolist()


@pytest.mark.parametrize("bound", [None, 0])
def test_vectors(spark, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    r = random.Random(6)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [r.choice([0.0, 0.25, -0.25, 0.1]) for _ in range(16)], r.choice([0, 1, None])) for k in range(3, 90)]
    rows += [(100, None, 1), (101, [nan] * 16, 1), (102, [inf] + [0.0] * 15, 1), (103, [None] + [0.0] * 15, None), (104, [2.0**100, -(2.0**126)] + [2.0**19] * 14, 9), (105, [0.5] * 8, 1), (106, [], 1), (107, [2.0**70] * 16, 1)]
    rows += [(7, [0.5] * 16, 3), (7, [0.5] * 16, 3), (None, [0.25] * 16, 2), (1, None, 0), (2, [nan] + [0.0] * 15, 0)]
    rows = [(v, e and [None if x is None else float(np.float32(x)) for x in e], label) for v, e, label in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    found = vector_codes.code_vectors(df)
    assert all_rows(found, "vec_id", "code", "error", "label_error", "codebooks_sha256") == Counter(plain.vector_codes(rows))


def test_few_vectors_and_other_widths(spark):
    one = spark.createDataFrame([(1, [0.5] * 10, 1), (2, [0.25] * 10, 1)], "vec_id long, embedding array<float>, label int")
    assert [(r.vec_id, r.code, r.error) for r in vector_codes.code_vectors(one).orderBy("vec_id").collect()] == [(1, "00" * 8, 0), (2, "01" * 5 + "00" * 3, 0)]
    none = spark.createDataFrame([(1, [], 1)], "vec_id long, embedding array<float>, label int")
    assert [(r.code, r.error, r.label_error) for r in vector_codes.code_vectors(none).collect()] == [("00" * 8, 0, 0)]


def phrase_rows():
    r = random.Random(9)
    vocabulary = ["a", "b", "A", "c d", "é", "Ü", "x\u00a0y", "z", "\x00", "ñ.", ",", "e\tf", "g\n", "h!"]
    rows = [(r.choice(["en", "de", None, "und", ""]), " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, " \t\n.,"), ("en", "a b " * 5000), ("one", "same words here " * 12), ("one", "same words here, " * 3), ("rare", "a b c d"), ("en", "x" * 60_000), ("en", " " * 60_000 + "." * 1000)]
    return rows * 2


PHRASES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("bound", [None, 0])
def test_phrases(spark, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(collocations, "BROADCAST_PHRASES", 0)
        monkeypatch.setattr(collocations, "SLICE_BYTES", 100)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("clash"), "size": F.lit(1)}).repartition(4)
    words = 700 if bound is not None else collocations.SHARD_WORDS  # a text runs over several shards
    assert all_rows(collocations.top_phrases(docs, shard_words=words), *PHRASES) == Counter(plain.collocations(rows))
    assert all_rows(collocations.top_phrases(docs, top=3, min_count=2, shard_words=words), *PHRASES) == Counter(plain.collocations(rows, least=2, top=3))


def test_longer_phrases(spark):
    rows = phrase_rows()[:120]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert all_rows(collocations.top_phrases(docs, longest=5, min_count=4), *PHRASES) == Counter(plain.collocations(rows, longest=5, least=4))


def test_as_many_languages_as_texts():
    shard = collocations.Shard(3)
    for k in range(100_000):
        shard.put([b"w%d" % k] * 3 + [b"."], str(k))
    found = {size: n.tolist() for size, _, n, _ in shard.counts(carry=False)}
    assert found == {1: [3] * 100_000, 2: [2] * 100_000, 3: [1] * 100_000}


def test_suffix_array_sorts_by_what_follows():
    r = np.random.default_rng(1)
    for depth in (1, 2, 3, 7):
        x = r.integers(0, 3, 200)
        order = collocations.suffix_array(x, depth)
        follow = [tuple(x[i : i + depth]) for i in order]
        assert sorted(order.tolist()) == list(range(200)) and follow == sorted(follow)


def test_scratch_blocks_of_two_threads_leave_each_other_alone(spark):
    inside, done, kept = threading.Event(), threading.Event(), []

    def other():
        with common.scratch(spark):
            kept.append(common.materialize(spark.range(5), "other"))
            inside.set()
            done.wait(60)
            kept.append(kept[0].count())

    thread = threading.Thread(target=other)
    thread.start()
    with common.scratch(spark):
        inside.wait(60)
        common.materialize(spark.range(3), "mine").count()
    done.set()
    thread.join()
    assert kept[1] == 5


def test_session_without_a_checkpoint_folder(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    (tmp_path / "conf").mkdir()
    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
import __spark_entry__
for name in ("op1_mix_sources", "op11_url_filter"):
    print("ROWS", __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = os.environ | {"PYTHONPATH": str(root), "SPARK_CONF_DIR": str(tmp_path / "conf")}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.count("ROWS") == 2, done.stderr[-2000:]


@pytest.mark.parametrize("space", [" ", "\n", "\u3000"])
@pytest.mark.parametrize("special", [True, False])
def test_millions_of_spaces_are_encoded_as_by_the_plain_library(space, special):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    from marketloom.llm.packing import encoder

    at = public_tokenizers.path("byte_bpe_50k.json")
    encode = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, at, special)
    spec = json.load(open(at, encoding="utf-8"))
    whole = Tokenizer.from_str(json.dumps(spec | {"added_tokens": spec["added_tokens"] if special else []}))
    text = "a b<|endoftext|>" + space * (3_000_000 if space != "\u3000" else 1_200_000) + "<|endoftext|> tail"
    assert encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_vectors_in_arrow_slices():
    whole = pa.array([[0.5, 0.25], [0.125, 1.0], [2.0, 3.0]], pa.list_(pa.float64()))
    assert vector_codes.integers(whole.slice(1, 2), 2, 2, 4096).ravel().tolist() == [512, 4096, 8192, 12288]
