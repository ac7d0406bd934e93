"""Scoring texts by a probabilistic suffix tree (operator 10).

Symbols are words, and one end per text. The root's distribution is that of all training symbols, each count 0.5
higher, with one class for unknown words. Contexts of one and two words that were seen MIN_COUNT times (in small corpora:
that make up P_MIN of the symbols) are candidates; one is kept if the next symbols seen after it diverge from those of
its shorter suffix by MIN_GAIN bits or more in all, and suffixes of kept contexts are kept. From three words on,
candidates are the contexts whose suffix was kept, a level at a time, until no context of a level is kept. After a kept context, next
symbols seen so often with it have their own (discounted) probability, and the others share the rest as after its
suffix. A text's score is the sum of log10 probabilities, each after the longest kept suffix of what went before.

Contexts and explicit symbols grow with the corpus and stay distributed. A score is a sum over a text's runs of one, two
and more symbols, up to one more than the deepest context: a kept context adds the log of what it leaves to others, an explicit symbol its own log less what the
shorter runs add, a known word its own log less that of an unknown one. So one table of (hash of a run, values) is all
that scoring needs. Its LOCAL_ROWS rows of most occurrences are looked up within tasks; occurrences of others are joined
with the table by hash, and as each is rarer than all of those, no hash has more than about 1 / LOCAL_ROWS of all
occurrences there. A run is counted only where its parts are frequent; pairs and triples are counted by 32 bits of their
hash first, so that the many that are seen a few times are not shuffled whole. Bitmaps of bounded size spare most
occurrences that would find nothing; they decide no result.

Words and runs are told apart by a 64-bit hash, which is made for all words of a slice of bytes at once. Defined cases: null or empty text is the end alone; null doc_id counts as
the empty text in the rule for held-out rows and is carried; repeated rows are counted and scored each; an empty table
gives an empty result, an empty training part a root of one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, table

MIN_COUNT = 32
#: The least count is no more than this share of the symbols, so that small corpora have contexts too.
P_MIN = 2.0**-15
#: 32 bytes each in every task; they come through the driver as arrays.
LOCAL_ROWS = 1 << 20
MIN_GAIN = 64.0
DISCOUNT = 0.5
END = 0
#: Bits of a symbol's number in packed contexts of Tree.
BITS = 16
#: Bytes of text that are in memory as arrays at a time (one text at least), and runs that are added up before they are sent.
SLICE = 1 << 18
HELD = 4_000_000
#: A word's hash is a sum over its bytes, which is made in blocks of so many; longer words than LONG bytes are hashed one by one.
BLOCK = 1 << 17
LONG = 256
PLACE = 0x9E3779B97F4A7C15
#: Bitmaps have 32 bits an entry, but at most 2 ** MAP_BITS.
MAP_BITS = 27
#: The hash of a run is that of the run without its last symbol times this number, plus the last symbol's.
FACTOR = np.int64(0x1E3779B97F4A7C15)
BROADCAST_WORDS = 400_000


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


#: Stands for any next symbol; a word has no space.
ANY = b" "


def signed(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


#: The end as a hash; words are never empty.
END_CODE = signed(b"")
#: White space of words; a number for each byte, the same for both cases of a letter; powers that a byte's place counts with, and their inverses.
SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
OF_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)
POWERS = np.cumprod(np.full(BLOCK + LONG, PLACE, np.uint64))
INVERSES = np.cumprod(np.full(BLOCK + LONG, pow(PLACE, -1, 1 << 64), np.uint64))


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each word data[start:end], ASCII letters in lower case, from running sums over blocks of bytes."""
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + BLOCK, BLOCK))
    for k, (first, last) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if first == last:
            continue
        piece = data[k * BLOCK : (k + 1) * BLOCK + LONG]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(np.take(OF_BYTE, piece) * POWERS[: len(piece)], out=sums[1:])
        start, end = starts[first:last] - k * BLOCK, np.minimum(ends[first:last] - k * BLOCK, len(piece))
        out[first:last] = (sums[end] - sums[start]) * INVERSES[start]
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        out ^= out >> np.uint64(33)
        out *= np.uint64(factor)
    out ^= out >> np.uint64(33)
    out = out.view(np.int64)
    for k in np.flatnonzero(ends - starts > LONG):
        out[k] = signed(data[starts[k] : ends[k]].tobytes().lower())
    return out


def symbols_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as sliced, of texts that lie in data from bound to bound."""
    word = ~SPACES[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inside = bounds[(bounds > 0) & (bounds < len(data))]
    first[inside], last[inside - 1] = word[inside], word[inside - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = np.diff(np.searchsorted(starts, bounds)) + 1
    symbols, inner = np.full(len(starts) + len(sizes), END_CODE), np.ones(len(starts) + len(sizes), bool)
    inner[np.cumsum(sizes) - 1] = False
    symbols[inner] = hashes_of(data, starts, ends)
    return symbols, sizes


def sliced(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of words, with the end after each text; number of symbols of each text) of some texts at a time."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1
        end = max(at + 1, min(end, at + SLICE, n))
        yield symbols_of(data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
        at = end


def longer(runs: np.ndarray, last: np.ndarray) -> np.ndarray:
    return runs * FACTOR + last


def word_counts(training: DataFrame) -> DataFrame:
    """code (hash), n of each training word; tasks add up what they have before it is shuffled."""

    def added(held: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for symbols, _ in sliced(batch.column(0)):
                held.append(symbols[symbols != END_CODE])
                size += len(held[-1])
                if size > HELD:
                    yield added(held)
                    size = 0
        yield added(held)

    return training.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def packed(symbols: np.ndarray, width: int) -> np.ndarray:
    """For each position from width - 1 on, the last width symbols as one number; -1 if one of them is none."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(width):
        part = symbols[k : k + n]
        code = (code << BITS) | np.maximum(part, 0)
        known &= part >= 0
    return np.where(known, code, -1)


def within(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code is in sorted_codes, and whether it is there."""
    if not len(sorted_codes):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return at, sorted_codes[at] == codes


class Places:
    """Where hashes are in a sorted array of distinct ones: by their first bits, then one by one among the few that share them."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.shift = codes, 64 - max(1, len(codes).bit_length())
        self.firsts = np.searchsorted(codes >> self.shift, np.arange(-1 << (63 - self.shift), (1 << (63 - self.shift)) + 1)).astype(np.int32)

    def within(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same as the function."""
        some = (codes >> self.shift) + (1 << (63 - self.shift))
        at, end = self.firsts[some], self.firsts[some + 1]
        there, left = np.zeros(len(codes), bool), np.flatnonzero(at < end)
        while len(left):
            own, sought = self.codes[at[left]], codes[left]
            there[left[own == sought]] = True
            left = left[own < sought]
            at[left] += 1
            left = left[at[left] < end[left]]
        return at, there


class Bitmap:
    """Whether a hash may be in a table: never a wrong no. A hash sets two bits."""

    def __init__(self, codes: DataFrame):
        rows = codes.count()
        self.bits = min(MAP_BITS, max(15, (32 * rows).bit_length()))
        bits = F.array("code", F.shiftright("code", 32))
        bit = F.col("at").bitwiseAND(F.lit((1 << self.bits) - 1)) + 1
        parts = codes.select(F.explode(bits).alias("at")).groupBy(F.bitmap_bucket_number(bit).alias("part"))
        self.bytes = np.zeros((1 << self.bits) // 8, np.uint8)
        for part, own in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("map")).collect():
            self.bytes[(part - 1) * 4096 : part * 4096] = np.frombuffer(own, np.uint8)

    def has(self, at: np.ndarray) -> np.ndarray:
        at = at & ((1 << self.bits) - 1)
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def may_have(self, codes: np.ndarray) -> np.ndarray:
        out = self.has(codes)
        some = np.flatnonzero(out)
        out[some] = self.has(codes[some] >> 32)
        return out


def slots_of(codes: np.ndarray) -> np.ndarray:
    """The slots of codes, their upper halves, as numbers of which both halves differ, for a bitmap."""
    upper = codes >> 32
    return ((upper >> 5) << 32) | (upper & 0xFFFFFFFF)


def likely(counts: DataFrame, least: float) -> Bitmap:
    """What may be frequent, from counts (slot, n) of the slots of runs: a run is no more frequent than its slot."""
    found = materialize(counts.groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= float(least)).select(F.col("slot").cast("long").alias("slot")), "slots")
    return Bitmap(found.select(F.shiftleft(F.shiftright("slot", 5), 32).bitwiseOR(F.col("slot").bitwiseAND(F.lit(0xFFFFFFFF))).alias("code")))


def run_counts(training: DataFrame, width: int, parts: Bitmap, least: float, label: str) -> DataFrame:
    """code, before (hash of the run without its last symbol), last, n of runs of two or three symbols seen that often.

    parts: what the runs one shorter that are frequent may be. A first reading adds up slots of 32 bits, so that of all
    the runs that are seen a few times only half a hash each is shuffled.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for symbols, _ in sliced(batch.column(0)):
                inner = symbols != END_CODE
                before, last, ok = symbols[:-1], symbols[1:], inner[:-1]
                shorter = parts.may_have(symbols)
                if width == 3:
                    pairs = longer(before, last)
                    before, last, ok = pairs[:-1], symbols[2:], ok[:-1] & inner[1:-1]
                    shorter = parts.may_have(pairs)
                ok = ok & shorter[:-1] & shorter[1:]
                yield before[ok], last[ok]

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for before, last in found(batches):
            held.append((longer(before, last) >> 32).astype(np.int32))
            size += len(before)
            if size > HELD:
                yield slots_added(held)
                size = 0
        yield slots_added(held)

    def slots_added(held: list[np.ndarray]) -> pa.RecordBatch:
        own, n = np.unique(np.concatenate([np.zeros(0, np.int32), *held]), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype(np.int64))], names=["slot", "n"])

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        before = np.concatenate([np.zeros(0, np.int64), *(b for b, _ in held)])
        last = np.concatenate([np.zeros(0, np.int64), *(x for _, x in held)])
        held.clear()
        some, n = first_of_each(longer(before, last))
        return pa.RecordBatch.from_arrays([pa.array(before[some]), pa.array(last[some]), pa.array(n)], names=["before", "last", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for before, last in found(batches):
            ok = likely_ones.may_have(slots_of(longer(before, last)))
            held.append((before[ok], last[ok]))
            size += len(held[-1][0])
            if size > HELD:
                yield added(held)
                size = 0
        yield added(held)

    texts = training.select("text")
    likely_ones = likely(texts.mapInArrow(slots, "slot int, n long"), least)
    counts = texts.mapInArrow(run, "before long, last long, n long").groupBy("before", "last").agg(F.sum("n").alias("n"))
    return materialize(with_codes(counts.where(F.col("n") >= float(least)), "before long, last long, n long"), label)


def first_of_each(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct code is once, and how often it is there."""
    order = np.argsort(codes)
    codes = codes[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return order[starts], np.diff(np.append(starts, len(codes))).astype(np.int64)


def with_codes(rows: DataFrame, columns: str) -> DataFrame:
    """rows with the hash of before and last as code."""
    names = [x.split()[0] for x in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = longer(batch.column("before").to_numpy(), batch.column("last").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(codes), *batch.columns], names=["code", *names])

    return rows.select(*names).mapInArrow(run, f"code long, {columns}")


def deeper_counts(training: DataFrame, depth: int, suffixes: Bitmap, shorter: Bitmap, threes: Bitmap, least: float) -> DataFrame:
    """code, before, suffix, last, n of runs that follow contexts of so many words whose suffix was kept; last is ANY where
    n counts the context itself. shorter: what the runs without their first symbol that are frequent may be; threes: what
    the frequent runs of three are, of which a frequent context begins with one."""
    any_code = signed(ANY)

    def added(held: list[np.ndarray]) -> pa.RecordBatch:
        before, suffix, last = np.concatenate([np.zeros((3, 0), np.int64), *held], axis=1)
        held.clear()
        some, n = first_of_each(longer(before, last))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (before[some], suffix[some], last[some], n)], names=["before", "suffix", "last", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for symbols, _ in sliced(batch.column(0)):
                inner = symbols != END_CODE
                runs, words = symbols, inner
                for k in range(1, depth - 1):
                    runs, words = longer(runs[:-1], symbols[k:]), words[:-1] & inner[k:]
                # runs: of depth - 1 symbols; one more makes a context, or what follows its suffix.
                wide, whole = longer(runs[:-1], symbols[depth - 1 :]), words[:-1] & inner[depth - 1 :]
                at = np.flatnonzero(whole[:-1])
                at = at[suffixes.may_have(runs[1:-1][at])]
                at = at[threes.may_have(longer(longer(symbols[at], symbols[at + 1]), symbols[at + 2]))]
                said = at[shorter.may_have(wide[at + 1])]
                for places, last in ((at, np.full(len(at), any_code)), (said, symbols[said + depth])):
                    held.append(np.stack([wide[places], runs[places + 1], last]))
                    size += len(places)
                if size > HELD:
                    yield added(held)
                    size = 0
        yield added(held)

    columns = "before long, suffix long, last long, n long"
    found = training.select("text").mapInArrow(run, columns).groupBy("before", "suffix", "last").agg(F.sum("n").alias("n"))
    return materialize(with_codes(found.where(F.col("n") >= float(least)), columns), "deeper")


def tested(rows: DataFrame) -> DataFrame:
    """before, total, share (of what other symbols have after the suffix), gain; from rows (before, total, n, own, old)."""
    sums = rows.groupBy("before").agg(
        F.first("total").alias("total"), F.sum("n").alias("seen"), F.count(F.lit(1)).alias("k"), F.sum("old").alias("old"),
        F.sum(F.col("n") * F.log2(F.col("own") / F.col("old"))).alias("gain"),
    )
    left = F.col("total") - F.col("seen")
    share = (left + DISCOUNT * F.col("k")) / F.col("total") / F.greatest(1 - F.col("old"), F.lit(1e-9))
    return sums.select("before", "total", share.alias("share"), (F.col("gain") + left * F.log2(share)).alias("gain"))


def run_values(training: DataFrame, words: DataFrame, below: float, least: float, min_gain: float) -> tuple[DataFrame, int]:
    """code, value, n: what each occurrence of a run adds to a score; words (code, n) are the symbols seen often enough.
    With them, the number of levels that were looked at: runs have at most one symbol more."""
    pairs = run_counts(training, 2, Bitmap(words.select("code")), least, "pairs")
    triples = run_counts(training, 3, Bitmap(pairs.select("code")), least, "triples")
    known = maybe_broadcast(words, BROADCAST_WORDS)
    own = (F.col("n") - DISCOUNT) / F.col("total")
    pairs = pairs.join(known.select(F.col("code").alias("before"), F.col("n").alias("total")), "before")
    pairs = pairs.join(known.select(F.col("code").alias("last"), ((F.col("n") + 0.5) / F.lit(float(below))).alias("old")), "last")
    pairs = materialize(pairs.select("code", "before", "last", "n", "total", own.alias("own"), "old"), "pairs")
    # The parts of a frequent run are frequent, so these joins lose nothing.
    triples = triples.join(pairs.select(F.col("code").alias("before"), F.col("last").alias("middle"), F.col("n").alias("total")), "before")
    triples = triples.join(pairs.select(F.col("before").alias("middle"), "last", F.col("own").alias("old")), ["middle", "last"])
    triples = materialize(triples.select("code", "before", "middle", "last", "n", "total", own.alias("own"), "old"), "triples")
    two = materialize(tested(triples).where(F.col("gain") >= float(min_gain)), "contexts")
    suffixes = pairs.select("code", "last").join(two.select(F.col("before").alias("code")), "code", "left_semi")
    suffixes = suffixes.select(F.col("last").alias("before")).distinct().withColumn("suffix", F.lit(True))
    one = tested(pairs).join(suffixes, "before", "left").where((F.col("gain") >= float(min_gain)) | F.col("suffix"))
    one = materialize(one.select("before", "total", "share"), "contexts")
    value = (F.log10("own") - F.log10("share") - F.log10("old")).alias("value")
    levels, threes = [(pairs, one), (triples, two)], Bitmap(triples.select("code"))
    while not levels[-1][1].isEmpty():
        runs, kept = levels[-1]
        found = deeper_counts(training, len(levels) + 1, Bitmap(kept.select(F.col("before").alias("code"))), Bitmap(runs.select("code")), threes, least)
        totals = found.where(F.col("last") == signed(ANY)).select("before", F.col("n").alias("total"))
        rows = found.where(F.col("last") != signed(ANY)).join(totals, "before")
        # What follows a kept suffix was counted one level before.
        rows = rows.join(runs.select(F.col("before").alias("suffix"), "last", F.col("own").alias("old")), ["suffix", "last"])
        rows = materialize(rows.select("code", "before", "suffix", "last", "n", "total", own.alias("own"), "old"), "runs")
        levels.append((rows, materialize(tested(rows).where(F.col("gain") >= float(min_gain)), "contexts")))
    both = None
    for runs, kept in levels:
        contexts = kept.select(F.col("before").alias("code"), F.log10("share").alias("value"), F.col("total").alias("n"))
        explicit = runs.select("code", "before", "n", "own", "old").join(kept.select("before", "share"), "before").select("code", value, "n")
        both = contexts.unionByName(explicit) if both is None else both.unionByName(contexts).unionByName(explicit)
    return materialize(both.groupBy("code").agg(F.sum("value").alias("value"), F.max("n").alias("n")), "values"), len(levels)


def score_table(counts: DataFrame, values: DataFrame) -> DataFrame:
    """code, word (log10 of a known word's probability against an unknown one's), known, value, level: one row per hash."""
    of_word = F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5))
    words = counts.select("code", of_word.alias("word"), F.lit(1).alias("known"), F.lit(0.0).alias("value"), "n")
    both = words.unionByName(values.select("code", F.lit(0.0).alias("word"), F.lit(0).alias("known"), "value", "n"))
    rows = both.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("word", "known", "value")], F.max("n").alias("n"))
    return rows.select("code", "word", "known", "value", F.floor(4 * F.log2("n")).cast("int").alias("level"))


def local_level(rows: DataFrame, most: int) -> int:
    """The least level from which on there are at most so many rows; there are four levels to a doubling of counts."""
    least = None
    for level, n in sorted(rows.groupBy("level").count().collect(), reverse=True):
        most -= n
        if most < 0:
            break
        least = level
    return 1 << 30 if least is None else least


class Tree:
    """The same model in one process, which tests hold against the tables. Kept contexts by depth with the log10 of what is left to other symbols, and explicit next symbols."""

    def __init__(self, root: dict[int, float], levels: list[dict[int, int]], first: dict[int, int], min_gain: float = MIN_GAIN):
        """root: probability of each frequent symbol; first: their counts; levels: counts of runs of 2, 3, ... symbols."""
        one = (1 << BITS) - 1
        counts = [first, *levels]
        following: list[dict[int, dict[int, int]]] = []
        for level in levels:
            after: dict[int, dict[int, int]] = {}
            for code, n in level.items():
                after.setdefault(code >> BITS, {})[code & one] = n
            following.append(after)
        nodes: list[dict[int, tuple[float, dict[int, float]]]] = [{} for _ in levels]

        def probability(depth: int, context: int, symbol: int) -> float:
            if depth == 0:
                return root.get(symbol, 0.0)
            share, explicit = nodes[depth - 1].get(context, (1.0, {}))
            if symbol in explicit:
                return explicit[symbol]
            return share * probability(depth - 1, context & ((1 << (BITS * (depth - 1))) - 1), symbol)

        kept: list[set[int]] = [set() for _ in levels]
        for depth, after in enumerate(following, 1):
            for context, nexts in after.items():
                suffix = context & ((1 << (BITS * (depth - 1))) - 1)
                if depth > 2 and suffix not in kept[depth - 2]:
                    continue
                total = counts[depth - 1][context]
                own = {s: (n - DISCOUNT) / total for s, n in nexts.items()}
                old = {s: probability(depth - 1, suffix, s) for s in nexts}
                rest, old_rest = 1 - sum(own.values()), max(1 - sum(old.values()), 1e-9)
                gain = sum(n * log2(own[s] / old[s]) for s, n in nexts.items()) + (total - sum(nexts.values())) * log2(rest / old_rest)
                nodes[depth - 1][context] = (rest / old_rest, own)
                if gain >= min_gain:
                    for d in range(depth, 0, -1):
                        kept[d - 1].add(context & ((1 << (BITS * d)) - 1))
        self.levels = []
        for depth, own in enumerate(nodes):
            contexts = np.array(sorted(c for c in own if c in kept[depth]), np.int64)
            shares = np.array([log10(own[int(c)][0]) for c in contexts])
            pairs = sorted(((int(c) << BITS) | s, log10(p)) for c in contexts for s, p in own[int(c)][1].items())
            self.levels.append((contexts, shares, np.array([c for c, _ in pairs], np.int64), np.array([p for _, p in pairs])))

    def score(self, symbols: np.ndarray, root: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum over positions, and where the root's own probability is part of it."""
        logs, from_root = root.copy(), np.ones(len(symbols), bool)
        for depth, (contexts, shares, pairs, values) in enumerate(self.levels, 1):
            codes = packed(symbols, depth)[: max(0, len(symbols) - depth)]
            at, there = within(contexts, codes)
            there &= codes >= 0
            if not there.any():
                continue
            where = np.flatnonzero(there) + depth
            logs[where] += shares[at[there]]
            nexts = symbols[where]
            pair_at, explicit = within(pairs, (codes[there] << BITS) | np.maximum(nexts, 0))
            explicit &= nexts >= 0
            logs[where[explicit]] = values[pair_at[explicit]]
            from_root[where[explicit]] = False
        return float(logs.sum()), from_root


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, codes array<long>"


def lists(codes: np.ndarray, docs: np.ndarray, n: int) -> pa.Array:
    """The codes of each of n documents; docs ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(n + 1)).astype(np.int32)), pa.array(codes))


def score_documents(docs: DataFrame, min_count: int = MIN_COUNT, p_min: float = P_MIN, local_rows: int = LOCAL_ROWS, min_gain: float = MIN_GAIN) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = docs.where(~held_out())
    counts = materialize(word_counts(training), "words")
    ends = training.count()
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = row[0] + ends, row[1] + (ends > 0)
    below = total + 0.5 * (distinct + 1)
    least = min(min_count, max(2, total * p_min))
    end = docs.sparkSession.range(1).select(F.lit(END_CODE).alias("code"), F.lit(ends).cast("long").alias("n"))
    values, levels = run_values(training, counts.unionByName(end).where(F.col("n") >= float(least)), below, least, min_gain)
    bitmap = Bitmap(values.select("code"))
    entries = materialize(score_table(counts, values), "entries")
    level = local_level(entries, local_rows)
    local = entries.where(F.col("level") >= level).drop("level").toArrow().sort_by("code")
    elsewhere = entries.where(F.col("level") < level)
    seen = Bitmap(elsewhere.select("code"))  # a word that only held-out texts have, however often, is no join key
    codes, word_logs, word_known, run_logs = (local.column(k).to_numpy() for k in range(4))
    end_log, unknown_log = log10((ends + 0.5) / below), log10(0.5 / below)

    def scored(symbols: np.ndarray, sizes: np.ndarray, places: Places) -> list[pa.Array]:
        n = len(sizes)
        doc, inner = np.repeat(np.arange(n), sizes), symbols != END_CODE
        base = np.bincount(doc, np.where(inner, unknown_log, end_log), n)
        # A run in the table has its context there, one symbol shorter, or is a context whose suffix is there; the longest
        # runs are no contexts. All but its last symbol are words.
        run, may, words, where, runs = symbols, inner & bitmap.may_have(symbols), inner, [np.flatnonzero(inner)], [symbols]
        for width in range(2, levels + 2):
            run = longer(run[:-1], symbols[width - 1 :])
            words = words[: len(run)] & inner[width - 2 :][: len(run)]
            shorter = may[:-1] | may[1:] if width <= levels else may[:-1]
            some = np.flatnonzero(words & shorter)
            may = np.zeros(len(run), bool)
            may[some] = bitmap.may_have(run[some])
            where.append(np.flatnonzero(may))
            runs.append(run)
        found = np.concatenate([some[ok] for some, ok in zip(runs, where, strict=True)])
        of = np.concatenate([doc[ok] for ok in where])
        at, here = places.within(found)
        at, known = at[here], of[here]
        base += np.bincount(known, word_logs[at], n)
        n_known = np.bincount(known, word_known[at], n).astype(np.int64) + (ends > 0)
        score = base + np.bincount(known, run_logs[at], n)
        here |= ~seen.may_have(found)
        found, of = found[~here], of[~here]
        order = np.argsort(of, kind="stable")
        return [pa.array(sizes), pa.array(n_known), pa.array(base), pa.array(score), lists(found[order], of[order], n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(codes)
        for batch in batches:
            at = 0
            for symbols, sizes in sliced(batch.column(3)):
                own = [c.slice(at, len(sizes)) for c in batch.columns[:3]]
                at += len(sizes)
                yield pa.RecordBatch.from_arrays([*own, *scored(symbols, sizes, places)], names=[x.split()[0] for x in SCORED.split(", ")])

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out().alias("held_out"), "text")
    rows = materialize(numbered.mapInArrow(run, SCORED), "scored")
    found = rows.select("rid", F.explode("codes").alias("code")).join(elsewhere, "code")
    found = found.groupBy("rid").agg(F.sum("word").alias("word"), F.sum("known").alias("more"), F.sum("value").alias("value"))
    add = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("codes").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + add("more")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + add("word")).alias("base_score"), (F.col("score") + add("word") + add("value")).alias("score"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
