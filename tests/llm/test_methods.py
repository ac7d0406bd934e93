"""The operators' methods on their own: properties that the queries' digests do not show."""

import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser
from math import log

import numpy as np
import pytest
from plain_import import plain
from pyspark.sql import functions as F
from test_queries import odd_rows

from marketloom.llm import common, exact_dedup, mixing, near_dedup, packing, page_text, personal, quality, secret_scan, suffix_tree


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_best_change_is_taken():
    lengths = np.random.default_rng(1).integers(1, 17, 300)
    bins = packing.sum_of_squares(lengths, 16)
    fill, count = {}, lambda: sum(n * n for n in np.bincount([16 - f for f in fill.values()], minlength=17)[1:].tolist())
    for n, b in zip(lengths.tolist(), bins.tolist(), strict=True):
        options = [f for f in {*fill.values(), 0} if f + n <= 16]
        was, new = fill.get(b, 0), {}
        for f in options:
            key = next((k for k, v in fill.items() if v == f), "new") if f else "new"
            old = fill.get(key)
            fill[key] = f + n
            new[f] = count()
            fill.pop(key) if old is None else fill.update({key: old})
        fill[b] = was + n
        assert count() == min(new.values())


def test_packing_is_near_the_bound():
    lengths = np.random.default_rng(2).integers(1, 1024, 8000)
    bins, by_squares = packing.pack_lengths(lengths)
    first = packing.sum_of_squares(lengths)
    assert 0.4 < by_squares.mean() < 1 and len(set(zip(first[by_squares], bins[by_squares], strict=True))) == len(set(bins[by_squares]))
    assert np.bincount(bins, weights=lengths).max() <= 1024
    assert bins.max() + 1 <= 1.01 * -(-lengths.sum() // 1024)


def test_one_byte_digests_are_settled_by_full_bytes(spark):
    rows = [(k, f"text {k % 150}" + " " * (k % 3), "s") for k in range(600)]
    _, found = exact_dedup.classes(frame(spark, rows), digest_bytes=1)
    groups = plain.exact([(d, t) for d, t, _ in rows])
    expected = {d: groups[t.replace(" ", "")] for d, t, _ in rows}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found.collect()}
    assert got == {d: (*g, d == g[0]) for d, g in expected.items()}


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_state_goes_on_with_later_batches(spark, tmp_path, digest_bytes):
    state, seen = f"file://{tmp_path}/state", []
    for batch in range(3):
        rows = [(1000 * batch + k, f"text {(k * (batch + 3)) % 170}" + " " * ((k + batch) % 3), "s") for k in range(120)]
        seen += rows
        for _ in range(2):  # a batch that is there already is not counted again
            _, found = exact_dedup.classes(frame(spark, rows), digest_bytes, state=state, batch=f"b{batch}")
            groups = plain.exact([(d, t) for d, t, _ in seen])
            expected = {d: groups[t.replace(" ", "")] for d, t, _ in rows}
            assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found.collect()} == {d: (*g, d == g[0]) for d, g in expected.items()}
    assert exact_dedup.classes(frame(spark, []), digest_bytes, state=state)[1].collect() == []


@pytest.mark.parametrize("block", [4, 64])
def test_crowded_regions_lose_no_link(spark, block):
    r = random.Random(block)
    words = [f"w{k}" for k in range(400)]
    base = r.choices(words, k=100)
    rows = []
    for k in range(150):
        own = list(base)
        for at in r.sample(range(100), r.choice([0, 1, 2, 4, 8])):
            own[at] = r.choice(words)
        rows.append((k, " ".join(own), "s"))
    rows += [(1000 + k, " ".join(r.choices(words, k=50)), "s") for k in range(50)]
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(frame(spark, rows), 4, 80, block).collect()}
    assert got == plain.near([(d, t) for d, t, _ in rows])


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.sql("SELECT 900L, 901L"))
    found = {r.node: r.comp for r in near_dedup.components(links).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def test_held_out_pages():
    weights, moves = page_text.trained()
    r = random.Random(99)
    wrong = total = 0
    for _ in range(200):
        page, labels = page_text.labelled_page(r)
        found = page_text.best_path(page_text.features(page_text.blocks(page)) @ weights, moves)
        wrong += sum(a != b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert wrong <= 0.02 * total


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(4)
    for n in range(1, 7):
        local, moves = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda path: sum(local[k, y] for k, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        assert value(page_text.best_path(local, moves)) == pytest.approx(max(map(value, paths)))


#: Lead-in phrases that the operator's own list lacks.
UNSEEN = {
    "dash": (["her telephone number is", "sms", "hotline"], ["serial", "page", "the code was"]), "paren": (["dial", "you may reach us under"], ["section", "issue"]),
    "plain": (["mobile", "cuenta"], ["tracking", "roughly"]), "tax": (["steuernummer", "tax id"], ["ticket", "model"]), "account": (["compte", "iban:"], ["commit", "sku"]),
    "hardware": (["ethernet", "my device has"], ["revision", "hash"]), "birth": (["he was born", "née le"], ["issue of", "dated"]), "document": (["ausweis", "id card"], ["release", "room"]),
    "address": (["he lives now at", "mail to"], ["built in", "lot"]), "name": (["regards,", "employee"], ["the works of", "published with"]), "handle": (["username", "profile:"], ["item", "the tag"]),
    "network": (["logged in as client", "host"], ["ref", "key"]),
}


def plain_features(kind, hit, before):
    found = []
    for what, rule in personal.FEATURES:
        if what in ("kind", "digits"):
            found.append((kind if what == "kind" else sum(c in "0123456789" for c in hit)) == rule)
        else:
            found.append(re.search(rule, hit if what == "hit" else before.lower()) is not None)
    return found


def test_trees_tell_unseen_phrases(spark):
    trees, least = personal.trained(spark)
    spans = personal.examples(spark, 2000, UNSEEN).select("label", F.explode(personal.proposals(F.col("text"))).alias("s"))
    rows = spans.select("label", "s.kind", "s.hit", "s.before", personal.features(F.col("s")).alias("f")).collect()
    assert {r.kind for r in rows} == set(personal.PROPOSED) and all(r.f == plain_features(r.kind, r.hit, r.before) for r in rows)
    m = personal.margins(trees, np.array([r.f for r in rows], bool))
    chosen = [r.label for r, x in zip(rows, m, strict=True) if x >= least]
    assert sum(chosen) >= 0.95 * len(chosen) and sum(chosen) >= 0.9 * sum(r.label for r in rows)


def test_added_spans_are_those_of_a_plain_version(spark):
    r = random.Random(12)
    hits = ["512-55-1234", "(555) 123-4567", "555-123-4567", "71234567890", "DE12 1234 5678 9012 34", "aa:bb:cc:dd:ee:ff", "3.4.1975", "C1234567", "12 Maple Street", "Dr. Anna Weber", "@anna_weber", "a@b.de", "10.0.0.1", "+1 323 555 9830", ":".join(["12ab"] * 8)]
    leads = ["ssn ", "call ", "order ", "phone: ", "born ", "passport ", "part no. ", "iban ", "dear ", "lives at ", "mac ", "follow ", "", "x", "client "]
    texts = ["".join(r.choice(leads) + r.choice(hits) + r.choice([" ", ", ", "-", ""]) for _ in range(r.choice([1, 5, 300]))) for _ in range(60)]
    trees, least = personal.trained(spark)
    got = {x.doc_id: x.spans for x in personal.find_personal(frame(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    added = 0
    for k, t in enumerate(texts):
        base, more = plain.personal_spans(t), []
        for rank, (kind, pattern) in enumerate(personal.PROPOSED.items(), 4):
            end = 0
            for m in re.finditer(pattern, t):
                before, end = t[end : m.start()][-24:], m.end()
                x = np.array([plain_features(kind, m[0], before)], bool)
                if personal.margins(trees, x)[0] >= least and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                    more.append((m.start(), rank, m.end(), kind))
        stay, far = [], 0
        for s in sorted(more):
            stay += [s] if s[0] >= far else []
            far = max(far, s[2])
        added += len(stay)
        assert got[k] == plain.join(base + stay)
    assert added > 500


def test_added_secrets_are_those_of_a_plain_version(spark):
    r = random.Random(13)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    values = ["".join(r.choices(letters, k=r.choice([18, 22, 40]))) for _ in range(40)] + ["0f" * 13, "AKIA" + "B7" * 10, "a1b2c3d4e5", "aaaa1111bbbb"]
    rows = []
    for k in range(150):
        own = [r.choice(["", "token=", "secret: ", "x-", "see "]) + (r.choice(values[:4]) if r.random() < 0.3 else r.choice(values)) for _ in range(r.choice([1, 3, 200]))]
        own += ["".join(r.choices(letters, k=24))] * (k % 3)  # of one repository
        rows.append((k, " ".join(own), r.choice(["a", "b", None]) if k < 100 else "hot"))
    texts = {d: t for d, t, _ in rows}
    owner = {d: s for d, _, s in rows}
    spans, seen = {}, {}
    for d, t in texts.items():
        base, more = plain.secret_spans(t), []
        for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", t):
            enough = all(sum(c in kind for c in m[0]) >= 2 for kind in ("0123456789", letters[:24] + "lo", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            if enough and len(set(m[0])) >= 8 and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                more.append((m.start(), 3, m.end(), "opaque"))
        value = lambda s: re.split(r"[:=]", t[s[0] : s[2]], maxsplit=1)[1].strip() if s[3] == "assign" else t[s[0] : s[2]]  # noqa: B023, E731
        spans[d] = base, [(s, value(s)) for s in base + more]
        for _, v in spans[d][1]:
            seen.setdefault(v, set()).add((d, owner[d]))
    live = lambda v: len({o for _, o in seen[v]}) < 2 and len(seen[v]) < 50 and len(set(v)) >= 8 and re.search("[0-9]", v) and not re.search(r"(.)\1\1\1", v)
    added = 0
    for x in secret_scan.find_secrets(frame(spark, rows)).collect():
        base, every = spans[x.doc_id]
        more = [s for s, v in every if s[3] == "opaque" and live(v)]
        added += len(more)
        assert x.spans == plain.join(base + more)
        assert x.n_live == sum(bool(live(v)) for _, v in every)
        assert x.ownership == ",".join(f"{s[3]}:{s[0]}:{s[2]}:{len(seen[v])}:{len({o for _, o in seen[v]})}" for s, v in sorted(every))
    assert added > 20


def test_many_spans_in_one_text(spark):
    text = "a@b.c 1.2.3.4 ssn 512-55-1234 token=abcdefgh Qw3rTy7UiOp9AsDfGhJkL2 " * 8000
    began = time.time()
    one = frame(spark, [(1, text, "s")])
    assert (x := personal.find_personal(one).first()).n_email == 8000 and x.spans.count("number") == 8000
    assert secret_scan.find_secrets(one).first().spans.count("opaque") == 8000
    assert time.time() - began < 120


def test_next_symbols_sum_to_one(spark):
    r = random.Random(6)
    first = {suffix_tree.END: 50, 1: 400, 2: 300, 3: 250}
    pairs = {(a << 16) | b: r.randint(20, 120) for a in (1, 2, 3) for b in (0, 1, 2)}
    triples = {(c << 16) | b: r.randint(2, 9) for c in list(pairs) if c & 65535 for b in (1, 2)}
    total = sum(first.values()) + 0.5 * (len(first) + 1)
    root = {s: (n + 0.5) / total for s, n in first.items()}
    tree = suffix_tree.Tree(root, [pairs, triples], first, min_gain=-1e9)
    for before in ([1], [2, 1], [1, 2], [3, 3]):
        share = 0.0
        for symbol in (*first, -1):
            plain_logs = np.log10([root[s] for s in before] + [root.get(symbol, 0.5 / total)])
            whole, _ = tree.score(np.array([*before, symbol]), plain_logs)
            part, _ = tree.score(np.array(before), plain_logs[:-1])
            share += 10 ** (whole - part)
        assert share == pytest.approx(1)


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = frame(spark, odd_rows()).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = common.materialize(stage(spark, now, str(tmp_path)), "stage")
        if name != "best-fit packing":
            assert now.columns == docs.columns
            seen.append([(r.doc_id, r.text) for r in now.collect()])
    quality, exact, near, mixed = seen
    assert set(quality) <= {(d, t) for d, t in rows if not plain.base_quality(t)[-1]}
    groups = plain.exact([(float("inf") if d is None else d, t) for d, t in quality])
    assert sorted(d for d, _ in exact if d is not None) == sorted(k for k, _ in groups.values() if k != float("inf"))
    comps = plain.near(exact, width=5)
    assert sorted((d for d, _ in near), key=str) == sorted((d for d, _ in exact if d is None or comps[d] == d), key=str)
    assert set(mixed) <= set(near) and max(mixed.count(x) for x in mixed) <= 3
    packed = {(r.doc_id, r.piece) for r in now.collect()}
    assert {d for d, _ in packed} == {d for d, _ in mixed}
    sized = mixing.mixed(frame(spark, []))
    assert sized.collect() == []


def test_contexts_go_by_absolute_counts(spark):
    # 2,000,000 training words; "north south" is seen 40 times, far below 2 ** -15 of them.
    train = [d for d in range(1000) if not spark_held_out(d)]
    rows = [(d, "other right fill " * 3333, "s") for d in train[:200]] + [(d, "north south", "s") for d in train[200:240]]
    probe = next(d for d in range(1000, 2000) if spark_held_out(d))
    found = {r.doc_id: r for r in suffix_tree.score_documents(frame(spark, [*rows, (probe, "north south", "s")])).collect()}
    assert found[probe].score > found[probe].base_score + 0.1


def spark_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


@pytest.mark.parametrize("local_rows", [1 << 20, 20, 0])
def test_tables_score_as_the_tree(spark, local_rows):
    r = random.Random(8)
    words = list("abcdefgh")
    rows = []
    for d in range(120):
        own = [r.choice(words)]
        for _ in range(r.randint(0, 60)):
            own.append(r.choice(words) if r.random() < 0.4 else words[(words.index(own[-1]) * 3 + len(own[-2:]) + (own[-2:-1] == ["a"])) % 8])
        rows.append((d, " ".join(own), "s"))
    number = {w: k for k, w in enumerate(words, 1)}
    first, pairs, triples = Counter(), Counter(), Counter()
    for d, t, _ in rows:
        if not spark_held_out(d):
            s = [number[w] for w in t.split()] + [0]
            first.update(s)
            pairs.update((a << 16) | b for a, b in zip(s, s[1:], strict=False))
            triples.update((a << 32) | (b << 16) | c for a, b, c in zip(s, s[1:], s[2:], strict=False))
    below = sum(first.values()) + 0.5 * (len(first) + 1)
    root = {s: (n + 0.5) / below for s, n in first.items()}
    often = lambda counts: {c: n for c, n in counts.items() if n >= 5}
    tree = suffix_tree.Tree(root, [often(pairs), often(triples)], dict(first), min_gain=20)
    assert len(tree.levels[0][0]) and len(tree.levels[1][0])
    found = suffix_tree.score_documents(frame(spark, rows), min_count=5, p_min=1.0, local_rows=local_rows, min_gain=20).collect()
    for x in found:
        s = np.array([number[w] for w in rows[x.doc_id][1].split()] + [0])
        assert x.score == pytest.approx(tree.score(s, np.log10([root[k] for k in s]))[0])
    assert len(found) == len(rows)


@pytest.mark.parametrize("memory", [3, 4])
def test_deeper_contexts_score_as_the_tree(spark, monkeypatch, memory):
    """Texts whose next word hangs on one three or four words before: contexts go on until none is kept."""
    monkeypatch.setattr(suffix_tree, "BITS", 6)
    r = random.Random(5)
    words = list("abcd")
    rows = []
    for d in range(400):
        own = r.choices(words, k=memory)
        for _ in range(r.randint(10, 60)):
            k = r.randint(1, memory)  # each level tells something
            own.append(r.choice(words) if r.random() < 0.05 else words[zlib.crc32("".join(own[-k:]).encode()) % 4])
        rows.append((d, " ".join(own), "s"))
    number = {w: k for k, w in enumerate(words, 1)}
    counts = [Counter() for _ in range(8)]
    for d, t, _ in rows:
        if not spark_held_out(d):
            s = [number[w] for w in t.split()] + [0]
            for width in range(1, 9):
                for i in range(len(s) - width + 1):
                    counts[width - 1][sum(x << (6 * (width - 1 - k)) for k, x in enumerate(s[i : i + width]))] += 1
    below = sum(counts[0].values()) + 0.5 * (len(counts[0]) + 1)
    root = {s: (n + 0.5) / below for s, n in counts[0].items()}
    often = lambda c: {x: n for x, n in c.items() if n >= 5}
    tree = suffix_tree.Tree(root, [often(c) for c in counts[1:]], dict(counts[0]), min_gain=20)
    assert len(tree.levels[memory - 1][0]) > 5
    found = suffix_tree.score_documents(frame(spark, rows), min_count=5, p_min=1.0, local_rows=50, min_gain=20).collect()
    for x in found:
        s = np.array([number[w] for w in rows[x.doc_id][1].split()] + [0])
        assert x.score == pytest.approx(tree.score(s, np.log10([root[k] for k in s]))[0])
    assert len(found) == len(rows)


@pytest.mark.parametrize("labels", [[], [(9999, 1)], [(0, 1)]])
def test_few_trusted_rows_reject_no_clean_text(spark, labels):
    r = random.Random(5)
    words = ["".join(r.choices("etaoinshr", k=r.randint(2, 6))) for _ in range(200)]
    rows = [(k, " ".join(r.choices(words, k=80)), "s") for k in range(60)]
    found = quality.judged(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(x.kept and not x.base_failed for x in found) and len(found) == 60
    assert labels == [(0, 1)] or all(x.score == 0 for x in found)


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><meta charset=utf-8><title>T</title><body><article><p>{}</article>",
        "<head><title>T</title><link rel=x><article><p>{}</article>",
        "<article><select><option>One<option>Two<p>{}</article>",
        "<article><svg><path d=x><p>{}</article>",
        "<article><object data=x><p>{}</article>",
    ],
)
def test_unclosed_silent_elements_do_no_harm(page):
    text = "A long sentence of the article, with several words, that a reader would see."
    assert page_text.main_text(page.format(text), *page_text.trained()) == text


def test_values_in_many_repositories_of_one_owner_are_copies(spark):
    many, few = "Qw3rTy7UiOp9AsDfGhJkL2", "Zx8cVb6NmQ1wErTyUiOpA3"
    rows = [(k, f"see {many} here", "hot") for k in range(60)] + [(100 + k, f"see {few} here", "hot") for k in range(3)]
    for x in secret_scan.find_secrets(frame(spark, rows)).collect():
        live = x.doc_id >= 100
        assert (x.n_live, x.n_shared, x.spans) == ((1, 0, "opaque:4:26") if live else (0, 1, ""))
        assert x.ownership == f"opaque:4:26:{3 if live else 60}:1"


def test_nodes_alone_at_depth_are_compared_at_the_end(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words), "s"), (2, " ".join([*words, "more"]), "s")] + [(k, " ".join(f"x{k}y{j}" for j in range(60)), "s") for k in (3, 4)]
    docs = frame(spark, rows)
    path = lambda k: np.array([7] * 4 + [1000 * k + j for j in range(near_dedup.HASHES - 4)], ">u4").tobytes()
    found = [(k, 57, bytes([k]), path(k)) for k, _, _ in rows]
    found = spark.createDataFrame([(a, b, bytearray(c), bytearray(d)) for a, b, c, d in found], "doc_id long, n_shingles long, same binary, values binary")
    comps = near_dedup.near_components(docs, found, 4, 80, 2)
    assert {r.node: r.comp for r in comps.collect()} == {1: 1, 2: 1}


def test_boilerplate_is_not_compared_pair_by_pair(spark, monkeypatch):
    r = random.Random(21)
    common = [f"c{k}" for k in range(140)]
    rows = [(k, " ".join(common + [f"d{k}w{j}" for j in range(60)]), "s") for k in range(700)]
    for k in range(0, 700, 50):  # a few are near copies
        w = rows[k][1].split()
        w[r.randrange(200)] = "other"
        rows.append((1000 + k, " ".join(w), "s"))
    compared = []
    compare = near_dedup.compare
    monkeypatch.setattr(near_dedup, "compare", lambda rows, *more: compared.append(rows.count()) or compare(rows, *more))
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(frame(spark, rows), 4, 80, 8).collect()}
    assert got == {d: d - 1000 if d >= 1000 else d for d, _, _ in rows}
    assert compared[-1] < 5 * len(rows)


def test_large_groups_of_a_rare_shingle_lose_no_link(spark):
    r = random.Random(23)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for base in (r.choices(words, k=60) for _ in range(3)):
        rows += [(len(rows) + k, " ".join(x if r.random() > 0.03 else r.choice(words) for x in base), "s") for k in range(30)]
    sets, nodes = near_dedup.full_sets(frame(spark, rows), spark.range(90).withColumnRenamed("id", "node"), 4), spark.range(90).select(F.col("id").alias("node"), (F.col("id") % 40).alias("comp"))
    blocks = near_dedup.crowded_rest(nodes, common.materialize(sets, "sets"), 80, part=7)
    links = near_dedup.compare(blocks, common.materialize(sets, "sets"), 80).unionByName(nodes.select(F.col("node").alias("a"), F.col("comp").alias("b")))
    got = {x.node: x.comp for x in near_dedup.components(links).collect()}
    known = [(d, t) for d, t, _ in rows] + [(d % 40, t) for d, t, _ in rows]  # a node and its component are one
    assert all(got.get(d, d) == c for d, c in plain.near(known).items())


def test_levels_of_many_sources(spark):
    r = random.Random(22)
    rows = [(k, "w " * r.choice([1, 1, 3, 200]), None if k % 40 == 0 else f"s{r.randrange(90)}{'é' * (k % 2)}") for k in range(600)]
    totals, targets = plain.targets([(s, len(t.split())) for _, t, s in rows])
    sized = frame(spark, rows).select("source", F.size(F.split(F.trim("text"), " ")).cast("long").alias("size"))
    found = {x.source: x for x in mixing.source_targets(sized).collect()}
    assert {s: x.source_size for s, x in found.items()} == totals
    assert {s: x.target for s, x in found.items()} == pytest.approx(targets)
    assert sum(x.target for x in found.values()) == pytest.approx(sum(totals.values()))


def test_large_sides_are_shuffled(spark, monkeypatch):
    rows = [(k, f"a text of number {k % 40} with a few words more {k % 3}", "ab"[k % 2]) for k in range(160)]
    run = lambda: [
        sorted(map(str, exact_dedup.classes(frame(spark, rows))[1].select("doc_id", "keep_id", "group_size").collect())), sorted(map(str, near_dedup.near_groups(frame(spark, rows)).collect())),
        sorted(map(str, mixing.mixed(frame(spark, rows)).select("doc_id", "taken").collect())), sorted((x.doc_id, round(x.score, 6)) for x in suffix_tree.score_documents(frame(spark, rows)).collect()),
    ]
    small = run()
    for module, name in ((exact_dedup, "BROADCAST_ROWS"), (near_dedup, "BROADCAST_NODES"), (mixing, "BROADCAST_SOURCES"), (suffix_tree, "BROADCAST_WORDS")):
        monkeypatch.setattr(module, name, 0)
    assert run() == small


class PlainExtractor(HTMLParser):
    """The text of article elements without what their class words, or tags, say is something else."""

    BLOCKS = set("article body div footer h1 h2 html li main nav ol p section ul".split())

    def __init__(self):
        super().__init__()
        self.open, self.lines = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "
        elif tag not in ("meta", "img", "input", "link"):
            if tag in self.BLOCKS:
                while self.open and self.open[-1][0] in ("p", "b"):
                    self.open.pop()
            self.open.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.lines.append("")
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "article" in tags and not any(c == "ad" for _, c in self.open) and not {"script", "style", "nav", "footer"} & set(tags):
            self.lines[-1] += data

    def text(self, page):
        self.feed(page)
        self.close()
        lines = (re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ") for x in self.lines)
        return "\n".join(x for x in lines if x)


def test_pages_of_the_tables_against_a_plain_extractor(spark):
    found = page_text.op8_page_text(spark, "/root/testdata/sf0.01").select("page_id", "text")
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = found.collect()
    assert len(rows) == len(pages)
    assert all(r.text == PlainExtractor().text(pages[r.page_id]) for r in rows)


#: Layouts as several kinds of sites have them, which no training page is like: page, and the lines of its article.
SITES = [
    ("""<html><body><div id="wrapper"><div id="masthead"><a href=/>The Daily</a></div><div id="navbar"><a href=/a>World</a> <a href=/b>Sport</a></div>
      <div class="story-body"><h1>A bridge opens</h1><span>By A. Writer, 3 May</span><p>The new bridge opened on Monday, two years late.</p><div class="advertisement">Buy shoes today.</div>
      <p>Drivers said that they were glad of it.</p></div><div id="disqus_thread"><div>I like it, too bad it is late.</div></div><div class="legal">All rights reserved.</div></div>""",
     ["A bridge opens", "By A. Writer, 3 May", "The new bridge opened on Monday, two years late.", "Drivers said that they were glad of it."]),
    ("""<table width=100%><tr><td class=menu><a href=/>Home</a><br><a href=/c>Contact</a></td><td class=maintext><h2>Growing beans</h2>Beans like warm soil, and a place in the sun.<br><br>Water them in the morning.</td></tr>
      <tr><td class=footer colspan=2>Made with care</td></tr></table>""",
     ["Growing beans", "Beans like warm soil, and a place in the sun. Water them in the morning."]),
    ("""<!doctype html><body class=docs><header><p>Library docs</p></header><aside class=toc><ol><li><a href=#1>Install</a><li><a href=#2>Use</a></ol></aside>
      <main><h1>Install</h1><p>Run the installer, then start the service.</p><pre>make install</pre><h2>Use</h2><dl><dt>start</dt><dd>Starts the service in the background.</dd></dl></main>
      <form><label>Was this page helpful?</label><button>Yes</button></form><footer>&copy; The authors</footer>""",
     ["Install", "Run the installer, then start the service.", "make install", "Use", "start", "Starts the service in the background."]),
    ("""<div class="cookie-consent">We use cookies, as all do.</div><nav><a href=/>Blog</a></nav><article class="hentry"><h1>On walking</h1><p>Walking is slow, and that is good.</p>
      <blockquote>Slow is smooth.</blockquote><figure><img src=x><figcaption>A path in the woods, in autumn</figcaption></figure><p>So I walk to work on most days.</p>
      <div class="social-share"><a href=x>Tweet</a><a href=y>Mail</a></div></article><section id="comments"><p>Me too, every day!</p><p>Not when it rains.</p></section>""",
     ["On walking", "Walking is slow, and that is good.", "Slow is smooth.", "A path in the woods, in autumn", "So I walk to work on most days."]),
]


def test_layouts_that_training_lacks():
    right = total = 0
    for page, lines in SITES:
        got = page_text.main_text(page, *page_text.trained()).split("\n")
        right += len(set(got) & set(lines))
        total += len(set(got) | set(lines))
    assert right >= 0.9 * total


def test_pipeline_goes_on_after_a_lost_driver(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    docs = frame(spark, odd_rows()).withColumn("comp", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    work, ran, lost = f"file://{tmp_path}/work", [], [True]

    def noting(name, stage):
        def run(spark, docs, sf_dir):
            ran.append(name)
            if name == "mixing sources" and lost.pop():
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return name, run

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [noting(*s) for s in stages])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, str(tmp_path), work)
    lost.append(False)
    out = corpus_pipeline.run(spark, str(tmp_path), work)
    names = [n for n, _ in stages]
    assert ran == [*names[:4], *names[3:]]
    kept = {d for d, t, _ in odd_rows() if not plain.base_quality(t)[-1]}
    assert out.count() and {r.doc_id for r in out.collect()} <= kept
    assert corpus_pipeline.run(spark, str(tmp_path), work).count() == out.count() and len(ran) == 6


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("n_good", [0, 5, 60])
def test_verdicts_are_those_of_a_plain_version(spark, n_good):
    r = random.Random(31)
    words = ["".join(r.choices("etaoinshr", k=r.randint(2, 6))) for _ in range(200)]
    rows = [(k, " ".join(r.choices(words, k=80)) if k % 6 else " ".join("".join(r.choices("#*$%&|<>qxz0", k=6)) for _ in range(60)), "s") for k in range(90)]
    good = [k for k in range(90) if k % 6][:n_good]

    def grams(text):
        data = text.encode()
        code = lambda g: (int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 50
        return [code(data[i : i + 4]) for i in range(len(data) - 3)]

    raw, target = Counter(range(1 << 14)), Counter()
    for k, t, _ in rows:
        raw.update(grams(t))
        target.update(grams(t) if k in good else [])
    n, m = sum(raw.values()), sum(target.values())
    ratio = lambda g: round(1e6 * log((target[g] + quality.PRIOR * raw[g] / n) / (m + quality.PRIOR) / (raw[g] / n)))
    for x in quality.judged(frame(spark, rows), spark.createDataFrame([(k, 1) for k in good], "doc_id long, quality int")).collect():
        own = grams(rows[x.doc_id][1])
        score = sum(map(ratio, own)) / 1e6 / len(own)
        assert x.score == pytest.approx(score, abs=1e-5) and x.kept == (not x.base_failed and score >= quality.THRESHOLD)
