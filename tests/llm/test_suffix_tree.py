"""Operator 10: words are hashed as arrays of bytes, and what is seen a few times is shuffled as half a hash."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marketloom.llm import suffix_tree


@pytest.mark.parametrize("slice_bytes", [1, 50, 1 << 18])
def test_hashes_tell_words_apart_as_splitting_does(monkeypatch, slice_bytes):
    monkeypatch.setattr(suffix_tree, "SLICE", slice_bytes)
    r = random.Random(1)
    parts = ["a", "B", "b", "z", " ", "  ", "\t", "\x0b", "\n", "é", "É", "日", "　", "\xa0", "x" * 255, "Q" * 256, "q" * 257, "0110", "1001"]
    texts = [None, "", " "] + ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(500)]
    texts += ["ab " * (suffix_tree.BLOCK // 3) + "word over a block's end", "y" * (2 * suffix_tree.BLOCK), None, ""]
    for rows in (pa.array(texts).slice(1), pa.array(texts, pa.large_string()), pa.array([], pa.string()), pa.array([None], pa.string())):
        plain = [(x or "").encode().lower().split() for x in rows.to_pylist()]
        found = list(suffix_tree.sliced(rows))
        assert [n for _, sizes in found for n in sizes.tolist()] == [len(x) + 1 for x in plain]
        flat, codes = [w for x in plain for w in [*x, b""]], [c for symbols, _ in found for c in symbols.tolist()]
        assert len(flat) == len(codes)
        of_word = dict(zip(flat, codes, strict=True))
        assert codes == [of_word[w] for w in flat] and len(set(of_word.values())) == len(of_word)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_places_are_those_of_a_search(n):
    r = np.random.default_rng(n)
    codes = np.unique(np.concatenate([r.integers(-(1 << 63), (1 << 63) - 1, n), [-5, -4, 3, (1 << 63) - 1, -(1 << 63)][: n - 1]]).astype(np.int64)) if n else np.zeros(0, np.int64)
    sought = np.concatenate([codes, codes + 1, r.integers(-(1 << 63), (1 << 63) - 1, 100), [0, -1]]).astype(np.int64)
    (at, there), (plain_at, plain_there) = suffix_tree.Places(codes).within(sought), suffix_tree.within(codes, sought)
    assert there.tolist() == plain_there.tolist()
    assert at[there].tolist() == plain_at[there].tolist()


def test_only_slots_of_frequent_runs_are_likely(spark):
    rows = [(k, 3) for k in range(-300, 300)] + [(k, 4) for k in range(-20, 20)]
    found = suffix_tree.likely(spark.createDataFrame(rows, "slot int, n long"), 7)
    has = lambda slots: found.may_have(suffix_tree.slots_of(np.array(slots, np.int64) << 32))
    assert has(range(-20, 20)).all()
    assert has([k for k in range(-300, 300) if not -20 <= k < 20]).mean() < 0.1


@pytest.mark.parametrize("width", [2, 3])
def test_frequent_runs_are_counted_whole(spark, monkeypatch, width):
    monkeypatch.setattr(suffix_tree, "HELD", 500)
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghijklmnopqrst"[: r.choice([3, 20])]) for _ in range(30)) for _ in range(200)]
    counts = [Counter(tuple(w) for x in texts for s in [[*x.encode().split(), b""]] for w in zip(*(s[k:] for k in range(n)), strict=False)) for n in (1, 2, 3)]
    code = {w: c for x in pa.array(texts) for s in suffix_tree.sliced(pa.array([x.as_py()])) for w, c in zip([*x.as_py().encode().split(), b""], s[0].tolist(), strict=True)}

    def whole(run):
        out = np.int64(code[run[0]])
        with np.errstate(over="ignore"):
            for w in run[1:]:
                out = suffix_tree.longer(out, np.int64(code[w]))
        return int(out)

    often = [{w: n for w, n in c.items() if n >= 25} for c in counts]
    parts = suffix_tree.Bitmap(spark.createDataFrame([(whole(w),) for w in often[width - 2]], "code long"))
    found = suffix_tree.run_counts(spark.createDataFrame([(x,) for x in texts], "text string"), width, parts, 25, "runs")
    assert {x.code: (x.before, x.last, x.n) for x in found.collect()} == {whole(w): (whole(w[:-1]), code[w[-1]], n) for w, n in often[width - 1].items()}
    assert len(often[width - 1]) > 10
