"""All queries of the subpackage over odd and empty tables, against plain versions."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from plain_import import plain
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import queries, token_counts

CLASHES = "size key target kept file row digest sha rid n part order comp node base spans good bucket code other _key tree".split()


def odd_rows():
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdeäß", k=r.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    base = prose(120)
    long = prose(30_000)
    rows = [(k, prose(r.randint(1, 200)), r.choice(["a", "b", "é", None])) for k in range(40)]
    for k in range(8):  # near copies
        w = base.split()
        w[5 + 10 * k] = "changed"
        rows.append((100 + k, " ".join(w), "a"))
    rows += [(200, base, "b"), (201, "  " + base.replace(" ", "\n"), "b"), (202, base.upper(), "c"), (203, base, None), (204, base, "a")]
    rows += [(300, None, "a"), (301, "", "a"), (302, " \t\n\x0b\x0c\r ", "a"), (303, "one two", "a"), (304, "ONE two", "b"), (305, long, "a"), (306, "x" * 50_000, "a"), (307, " " * 50_000, "b")]
    rows += [(308, "no break   wide　space \U0001f600 é \x00 \x7f", "z"), (309, "same line\nsame line\n\nsame line \n" * 5, "z"), (310, "a b c d e " * 30, None)]
    rows += [(311, "Password: 'hunter22' token=abc api_key = \"Zz9/+_.=-a\" AKIA" + "B2" * 9 + " secret=token:abcdefg " + "0f" * 15 + " " + "f" * 23, "a")]
    rows += [(312, "é a.b-c@x-y.co.uk_d@e.fr 1.2.3.4.5.6.7.8 300.1.1.1 010.0.0.255 4111 1111-1111 1111, +1 (323) 555-9830, +12, 0000000000000000000000", "a")]
    rows += [(313, "a" * 20_000 + "@" + "b." * 5_000 + " " + "1" * 20_000 + " " + "1 " * 10_000 + "+" * 1000, "a"), (314, "live Qw3rTy7UiOp9AsDfGhJkL2 and ssn 512-55-1234 here", "a")]
    rows += [(315, "a <|endoftext|> b<|endoftext|><|endoftext|>c <|endoftext", "b")]
    rows += [(320, base, "a"), (320, base, "a"), (None, base + " null id", "a"), (321, "# * $ % & | < > " * 40, "b")]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *[F.lit("clash").alias(c) for c in CLASHES])
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 40, 2)] + [(1, 0, None), (3, None, 1), (None, 1, 0), (9999, 1, 1), (2, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "<article><p>Plain &amp; simple.<p>Second &#233; 'quoted' <b>bold</b></article><footer>&copy; x</footer>"),
             (5, "u", "<nav><ul><li><a href='>'>Home</a></ul></nav><article><h1>Title</h1><p>A paragraph of text,\n  with spaces, and\tmore.</p><script>if (a<b) '</p>'</script></article><div class=\"ad\">Buy now.</div>"),
             (5, "u", "<!-- <p>no</p> --><style>p{}</style>" + "<div>" * 3000), (7, "u", "<p " * 500)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).repartition(2).write.parquet(f"{at}/embeddings.parquet")
    return at, rows


def odd_vectors():
    r = random.Random(6)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [r.choice([0.0, 0.25, -0.25, 0.125]) for _ in range(16)], r.choice([0, 1, None])) for k in range(3, 60)]
    rows += [(100, None, 1), (101, [nan] * 16, 1), (102, [inf] + [0.0] * 15, 1), (103, [None] + [0.0] * 15, None), (104, [1e30, -3e38] + [5e5] * 14, 9), (105, [0.5] * 8, 1), (106, [], 1)]
    return rows + [(7, [0.5] * 16, 3), (7, [0.5] * 16, 3), (None, [0.25] * 16, 2), (1, None, 0), (2, [nan] + [0.0] * 15, 0)]


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{odd[0]}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def run(spark, odd, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, odd[0]).collect()], odd[1]


def by_row(found, *columns):
    return Counter(tuple(r[c] for c in columns) for r in found)


def test_mixing(spark, odd):
    found, rows = run(spark, odd, "op1_mix_sources")
    sizes = [(s, len(plain.words(t))) for _, t, s in rows]
    totals, targets = plain.targets(sizes)
    assert by_row(found, "doc_id", "size", "source_size") == Counter((d, n, totals[s]) for (d, _, _), (s, n) in zip(rows, sizes, strict=True))
    source = {(d, n): s for (d, _, _), (s, n) in zip(rows, sizes, strict=True)}
    taken = Counter()
    for r in found:
        s = source[r["doc_id"], r["size"]]
        assert r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    again, _ = run(spark, odd, "op1_mix_sources")
    assert by_row(again, "doc_id", "taken") == by_row(found, "doc_id", "taken")


def test_secrets(spark, odd):
    found, rows = run(spark, odd, "op2_secret_scan")
    expected = []
    for d, t, _ in rows:
        spans = plain.secret_spans(t)
        expected.append((d, *(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")), plain.sha(plain.join(spans))))
    assert by_row(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == Counter(expected)
    assert next(r["spans"] for r in found if r["doc_id"] == 314) == "opaque:5:27"


def test_packing(spark, odd):
    found, rows = run(spark, odd, "op3_pack_sequences")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for d, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert by_row(found, "doc_id", "piece", "start", "length", "ids_crc32") == expected
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert all(r["by_squares"] for r in found if r["length"] == 1024)
    assert len(places) <= 1.05 * sum(r["length"] for r in found) / 1024 + 1


def test_token_counts(spark, odd):
    found, rows = run(spark, odd, "op4_token_counts")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True  # the separator's name in a text is ordinary text here
    expected = Counter((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows)
    assert by_row(found, "doc_id", "n_tokens") == expected


@pytest.mark.parametrize("block_bytes", [2, 4, 6, 64, 1 << 20])
def test_separator_scan_stitches_blocks(spark, tmp_path, block_bytes):
    r = random.Random(block_bytes)
    expected = Counter()
    for k in range(3):
        lengths = [r.choice([0, 0, 1, 3, 40]) for _ in range(20)]
        tail = k * 7
        ids = [x for n in lengths for x in (*[5] * n, 9)] + [5] * tail
        np.array(ids, "<u2").tofile(tmp_path / f"f{k}.bin")
        starts = np.cumsum([0, *(n + 1 for n in lengths)])
        expected.update((f"f{k}.bin", i, int(starts[i]), n, True) for i, n in enumerate(lengths))
        if tail:
            expected[f"f{k}.bin", len(lengths), int(starts[-1]), tail, False] += 1
    (tmp_path / "none.bin").touch()
    found = token_counts.count_tokens(token_counts.scan_blocks(spark, f"file://{tmp_path}", 9, "<u2", block_bytes))
    assert Counter((x.file.rsplit("/", 1)[1], x.ordinal, x.start, x.n_tokens, x.ended) for x in found.collect()) == expected


def test_exact_dedup(spark, odd):
    found, rows = run(spark, odd, "op5_exact_dedup")
    groups = plain.exact([(float("inf") if d is None else d, t) for d, t, _ in rows])
    for r in found:
        norm = next(n for n in groups if plain.sha(n) == r["text_sha256"])
        assert (r["keep_id"], r["group_size"]) == groups[norm] or r["doc_id"] is None
    assert sum(r["kept"] for r in found) == len(groups)
    assert all(r["keep_id"] == r["doc_id"] for r in found if r["kept"])


def test_quality(spark, odd):
    found, rows = run(spark, odd, "op6_quality_rules")
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert by_row(found, *columns) == Counter((d, *plain.base_quality(t)) for d, t, _ in rows)
    assert not any(r["kept"] and r["base_failed"] for r in found)
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert 321 not in kept and 305 in kept


def test_near_dedup(spark, odd):
    found, rows = run(spark, odd, "op7_near_dedup")
    comps = plain.near([(d, t) for d, t, _ in rows])
    expected = Counter((d, len(plain.shingles(t, 4)), comps.get(d), d is None or comps[d] == d) for d, t, _ in rows)
    assert by_row(found, "doc_id", "n_shingles", "component_id", "kept") == expected


def test_pages(spark, odd):
    found, _ = run(spark, odd, "op8_page_text")
    texts = Counter((r["page_id"], r["text"]) for r in found)
    assert texts[4, "Plain & simple.\nSecond é 'quoted' bold"] == 1
    assert texts[5, "Title\nA paragraph of text, with spaces, and more."] == 1
    assert all(r["n_chars"] == len(r["text"]) for r in found) and len(found) == 7


def test_personal(spark, odd):
    found, rows = run(spark, odd, "op9_personal_data")
    expected = []
    for d, t, _ in rows:
        spans = plain.personal_spans(t)
        expected.append((d, *(sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone")), plain.sha(plain.join(spans))))
    assert by_row(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == Counter(expected)
    assert next(r["spans"] for r in found if r["doc_id"] == 314) == "number:36:47"


def test_scores(spark, odd):
    found, rows = run(spark, odd, "op10_lm_score")
    expected = plain.unigrams([(d, t) for d, t, _ in rows])
    assert by_row(found, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens") == Counter(x[:5] for x in expected)
    base = sorted((str(r["doc_id"]), r["base_score"]) for r in found)
    assert [x for x, _ in base] == sorted(str(x[0]) for x in expected)
    assert [x for _, x in base] == pytest.approx([s for _, s in sorted((str(x[0]), x[5]) for x in expected)])
    assert all(r["score"] < 0 for r in found)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_same_rows_as_in_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found, expected = queries.QUERIES[name](spark, sf), db.sql(queries.ORACLE_SQL[name])
    order = sorted(found.columns)
    assert sorted(expected.columns) == order
    assert Counter(tuple(r[c] for c in order) for r in found.collect()) == Counter(tuple(r[expected.columns.index(c)] for c in order) for r in expected.fetchall())
