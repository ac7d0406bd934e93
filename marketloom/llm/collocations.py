"""Phrases whose words go together, by suffix arrays of word ids (operator 13).

Tasks turn texts into word ids, with a break where a piece ends, some millions of words (a shard) at a time. Prefix
doubling sorts the shard's suffixes by their first words, the common prefix lengths of neighbours cut the order into
intervals, and each interval is a phrase with its count. Counts of all shards are merged by key.

Most phrases are rare, so the corpus is read twice. The first reading sends each phrase of a shard as a 64-bit hash with
its count (up to min_count, which is all that matters), packed by ranges of hashes; the ranges, as many as the corpus
needs, are merged one at a time. Hashes that come to min_count are set in a bitmap of at most 2^27 bits (16 MB), which
the second reading uses to send words of likely phrases only. A hash that meets another one, or a bitmap that fills up,
lets more phrases through and loses none; the counts in the end are of the phrases themselves.

A phrase's score is its squared count against the product of its two parts' counts, at the cut where that is lowest. A
phrase that lies within a longer candidate of half its count or more is dropped.

Defined cases: null text is empty, a null language is "und"; texts without words give nothing; repeated rows count each;
a text of any length is read by slices, and one that is longer than a shard runs on in the next; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, maybe_broadcast, salted_join, scratch, table, text_or_empty
from .suffix_tree import Bitmap

LONGEST = 3
MIN_COUNT = 10
#: Percent of a phrase's count from which a longer phrase takes its place.
CONTAINED = 50
TOP = 2000
SHARD_WORDS = 1_500_000
#: Texts are cut into words by slices of about this size.
SLICE_BYTES = 1 << 20
#: Text whose phrases are merged at a time.
RANGE_BYTES = 8 << 20
BROADCAST_PHRASES = 100_000
#: Ends of pieces become full stops, and the two kinds of space one.
MARKS = bytes.maketrans(b"\t,;:!?\n\x0b\x0c\r", b" .........")
ROWS = "lang string, size int, phrase string, f long"


def mixed_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Places of x in the order of what follows, by prefix doubling until depth symbols, or all places, are told apart."""
    n, h, rank = len(x), 1, x
    order = np.argsort(x, kind="stable") if depth == 1 else np.zeros(0, np.int64)
    while h < depth and n:
        follows = np.zeros(n, np.int64)
        follows[: n - h] = rank[h:] + 1
        key = rank * (int(follows.max()) + 1) + follows
        order = np.argsort(key)
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        rank, h = new, 2 * h
        if rank[order[-1]] == n - 1:
            break
    return order


class Ids(dict):
    """Numbers of words in order of appearance; 0 is the break."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


class Shard:
    """Word ids of some texts; counts the phrases that start in it."""

    def __init__(self, longest: int):
        self.longest, self.tail = longest, ([], [])
        self.clear()

    def clear(self) -> None:
        self.ids, self.langs = Ids({b".": 0}), Ids()
        self.parts, self.of, self.n = [], [], 0
        words, langs = self.tail
        self.tail = ([], [])
        for w, lang in zip(words, langs, strict=True):
            self.put([w], lang)

    def put(self, words: list[bytes], lang: str) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        self.of.append((self.langs[lang], len(words)))
        self.n += len(words)

    def counts(self, carry: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """size, places, counts and hashes of the phrases of each size, then the shard is empty. carry: a text goes on, so
        phrases of the last words wait for the next shard."""
        x = np.concatenate([*self.parts, np.zeros(0, np.int64)])
        lang = np.repeat(np.array([k for k, _ in self.of], np.int64), [n for _, n in self.of])
        self.x, self.lang, self.words, self.names = x, lang, list(self.ids), list(self.langs)
        limit = max(0, len(x) - self.longest + 1) if carry else len(x)
        self.tail = ([self.words[i] for i in x[limit:]], [self.names[k] for k in lang[limit:]])
        if len(x):
            yield from self._counts(x, lang, limit)
        self.clear()

    def _counts(self, x: np.ndarray, lang: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        word_hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        lang_hash = np.fromiter((xxhash.xxh3_64_intdigest(k.encode(), seed=1) for k in self.names), np.uint64, len(self.names))
        symbols = x * len(self.names) + lang  # words of two languages differ
        if symbols.max() >= 1 << 31:  # two of them in one number must fit 64 bits
            symbols = np.unique(symbols, return_inverse=True)[1]
        at = suffix_array(symbols, self.longest)
        padded = np.concatenate([symbols, np.full(self.longest, -1)])
        break_ = np.concatenate([x == 0, np.ones(self.longest, bool)])
        first = np.ones(len(x), bool)  # where the common prefix with the suffix before is shorter than the size
        first[1:] = False
        counted = at < limit
        for size in range(1, self.longest + 1):
            symbol = padded[at + size - 1]
            first[1:] |= symbol[1:] != symbol[:-1]
            counted &= ~break_[at + size - 1]
            starts = np.flatnonzero(first)
            n = np.add.reduceat(counted.astype(np.int64), starts)
            places, n = at[starts[n > 0]], n[n > 0]
            code = lang_hash[lang[places]]
            for k in range(size):
                code = mixed_bits(code + word_hash[x[places + k]] * np.uint64(0x9E3779B97F4A7C15))
            yield size, places, n, code

    def phrases(self, places: np.ndarray, size: int) -> pa.Array:
        words = pa.array(self.words, pa.binary())
        taken = [words.take(pa.array(self.x[places + k])) for k in range(size)]
        return pc.binary_join_element_wise(*taken, pa.scalar(b" ", pa.binary())).cast(pa.string())

    def languages(self, places: np.ndarray) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(self.lang[places]))


def slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, breaks among them, some at a time."""
    data = text.encode().lower().translate(MARKS)  # bytes: ASCII letters only
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        if end < len(data):
            end = data.rfind(b" ", at, end) if data.rfind(b" ", at, end) > at else data.find(b" ", end)
            end = end if end > 0 else len(data)
        yield data[at:end].replace(b".", b" . ").split()
        at = end
    yield [b"."]


def shards(batches: Iterator[pa.RecordBatch], longest: int, words: int) -> Iterator[tuple[Shard, int, np.ndarray, np.ndarray, np.ndarray]]:
    shard = Shard(longest)
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for own in slices(text.as_py()):
                shard.put(own, lang)
                if shard.n >= words:
                    for x in shard.counts(carry=True):
                        yield shard, *x
    for x in shard.counts(carry=False):
        yield shard, *x


def likely(docs: DataFrame, longest: int, min_count: int, shard_words: int) -> Bitmap:
    """What the hashes of phrases of min_count and more may be."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(64, -(-total // RANGE_BYTES))
    kind = np.dtype(np.uint8 if min_count < 256 else np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, n, code in shards(batches, longest, shard_words):
            order = np.argsort(code)
            code, n = code[order], np.minimum(n[order], min_count).astype(kind)
            part = ((code >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            ends = np.append(starts, len(code))
            pieces = [pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * w).astype(np.int32)), pa.py_buffer(v)]) for v, w in ((code, 8), (n, kind.itemsize))]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int64)), *pieces], names=["part", "codes", "counts"])

    def merged(group: pa.Table) -> pa.Table:
        code = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in group["codes"]])
        n = np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in group["counts"]])
        order = np.argsort(code)
        code, n = code[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        often = np.add.reduceat(n.astype(np.int64), starts) >= min_count
        return pa.table({"code": pa.array(code[starts[often]].view(np.int64))})

    sent = docs.select("lang", "text").mapInArrow(run, "part long, codes binary, counts binary")
    return Bitmap(materialize(sent.groupBy("part").applyInArrow(merged, "code long"), "likely"))


def phrase_counts(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, size, phrase, f of all phrases of one to longest words with at least min_count occurrences; of size 0 and
    without a phrase, each language's number of words."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(likely(docs, longest, min_count, shard_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for shard, size, places, n, code in shards(batches, longest, shard_words):
            if size == 1:
                total = np.bincount(shard.lang[places], weights=n, minlength=len(shard.names)).astype(np.int64)  # whole numbers below 2^53
                yield pa.RecordBatch.from_arrays([pa.array(shard.names, pa.string()), pa.array([0] * len(total), pa.int32()), pa.array([""] * len(total)), pa.array(total)], names=["lang", "size", "phrase", "f"])
            some = bitmap.may_have(code.view(np.int64))
            places, n = places[some], n[some]
            yield pa.RecordBatch.from_arrays([shard.languages(places), pa.array(np.full(len(n), size, np.int32)), shard.phrases(places, size), pa.array(n)], names=["lang", "size", "phrase", "f"])

    found = docs.mapInArrow(run, ROWS).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return found.where((F.col("f") >= min_count) | (F.col("size") == 0) & (F.col("f") > 0))


def scored(counts: DataFrame, longest: int = LONGEST, contained: int = CONTAINED) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one stands for."""
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": joined(F.lit(1), F.col("k")), "right": joined(F.col("k") + 1, F.col("size") - F.col("k"))})
    parts = counts.where((F.col("size") > 0) & (F.col("size") < longest))
    for side, name in (("left", "l"), ("right", "r")):  # a common word is a part of many phrases
        cuts = salted_join(cuts, parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], "inner", F.xxhash64("phrase"), BROADCAST_PHRASES)
    wide = lambda c: f"cast({c} AS decimal(19,0))"
    cuts = cuts.withColumn("score", F.expr(f"(1000000 * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Each shorter run of words within a longer candidate, with that one's count.
    inner = phrases.where("size > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1))).select("lang", joined(F.col("at"), F.col("n")).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def top_phrases(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, contained: int = CONTAINED, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    with scratch(docs.sparkSession):
        counts = materialize(phrase_counts(docs, longest, min_count, shard_words), "phrases")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        rows = scored(counts, longest, contained).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)).cast("int"))
        # A language's phrases are ranked in 64 parts, then the first of each part.
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
        return materialize(rows.join(maybe_broadcast(totals, BROADCAST_PHRASES), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
runs AS (SELECT lang, size, list_slice(ws, i, i + size - 1) AS ws FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS s(size) WHERE len(ws) >= size)),
counts AS MATERIALIZED (SELECT lang, size, ws, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
totals AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE size > 1),
cuts AS (SELECT c.lang, c.ws, c.f AS a, k, x.f AS l, y.f AS r, 1000000::hugeint * c.f * c.f // (x.f::hugeint * y.f) AS score FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.ws = list_slice(c.ws, 1, k) JOIN counts y ON y.lang = c.lang AND y.ws = list_slice(c.ws, k + 1, c.size)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
longer AS (SELECT lang, ws, max(f) AS f FROM (SELECT lang, f, unnest([ws[1:2], ws[2:3]]) AS ws FROM candidates WHERE size = 3) GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.ws = b.ws WHERE x.f IS NULL OR 100 * x.f < {CONTAINED} * a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, cast(n AS bigint) AS n, cast(score AS bigint) AS score
FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= {TOP}
"""
