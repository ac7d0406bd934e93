"""Quality rules by a hashed n-gram log-likelihood ratio (operator 6).

Two multinomials over hashed character n-grams are counted: of trusted target documents (a bounded sample of rows
labelled good) and of the raw corpus (all documents). A document's score is the mean, over its n-grams, of
log p_target - log p_raw; documents below a fixed threshold, and documents that fail the base rules, are rejected. The
target is smoothed towards the raw distribution with a fixed weight, so that few trusted n-grams leave scores near 0.
Ratios are rounded to millionths and summed as integers, so that a score depends on nothing but text and counts.

Defined cases: a null or empty text has no words, no n-grams and score 0, and fails the base rules; repeated rows are
scored each; labels that are null, repeated or without document are harmless; without any trusted n-gram all scores are
0 and the base rules alone decide; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ORDER = 4
BITS = 14
#: At most so many rows labelled good serve as the trusted target, those with the smallest hash of doc_id.
TARGET_ROWS = 20_000
#: Clean documents score -0.2 to 0.2 (from 1,000 documents on), junk -0.6 and less, whatever its share of the raw corpus.
THRESHOLD = -0.4
#: N-grams drawn from the raw distribution that are added to the trusted ones: those of some fifty documents.
PRIOR = 2.0**17
SCALE = 1_000_000
#: The symbols of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def hashed_grams(data: np.ndarray, order: int = ORDER, bits: int = BITS) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte, where one does."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(order):
        code = (code << np.uint64(8)) | data[k : k + n].astype(np.uint64)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def gram_counts(docs: DataFrame, trusted: DataFrame, order: int = ORDER, bits: int = BITS) -> DataFrame:
    """bucket, raw, target: counts over all documents and over the trusted ones (a bounded table of doc_id)."""
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                grams = hashed_grams(np.frombuffer((text.as_py() or "").encode(), np.uint8), order, bits)
                counts = np.bincount(grams, minlength=1 << bits)
                raw += counts
                if good:
                    target += counts
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    counted = flagged.select("text", "good").mapInArrow(run, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, bits: int = BITS) -> np.ndarray:
    """Millionths of log p_target - log p_raw per bucket, raw counts one higher. At most 2**bits rows come here."""
    raw, target = np.ones(1 << bits), np.zeros(1 << bits)
    for bucket, r, t in counts.collect():
        raw[bucket] += r
        target[bucket] += t
    p_raw = raw / raw.sum()
    p_target = (target + PRIOR * p_raw) / (target.sum() + PRIOR)
    return np.rint(SCALE * (np.log(p_target) - np.log(p_raw))).astype(np.int64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # Windows are numbered exactly: each step numbers the pairs of (windows one shorter, next word).
    code = ids[:n]
    for k in range(1, window):
        code = code * len(numbers) + ids[k : k + n]
        if k < window - 1 and len(numbers) ** (k + 2) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
IS_START = (np.arange(256) & 0xC0) != 0x80


def base_rules(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. bytes.split() splits at the same six characters."""
    words = data.split()
    codes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = int(codes[IS_START & ~IS_SPACE].sum())
    return len(words), chars, int(codes[IS_SYMBOL].sum()), duplicate_lines(data), repeated_words(words)


SCORES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, target_rows: int = TARGET_ROWS, order: int = ORDER, bits: int = BITS, carry: bool = False) -> DataFrame:
    """One row per document: counts, verdicts, score; with carry, instead the rows of docs that are kept."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    ratios = log_ratios(gram_counts(docs, trusted, order, bits), bits)
    columns = docs.columns if carry else ["doc_id", "text"]
    schema = docs.schema if carry else SCORES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for batch in batches:
            out = []
            for text in batch.column(at):
                data = (text.as_py() or "").encode()
                grams = hashed_grams(np.frombuffer(data, np.uint8), order, bits)
                score = int(ratios[grams].sum()) / SCALE / len(grams) if len(grams) else 0.0
                n_words, *rest = base_rules(data)
                failed = n_words < 10 or 100 * rest[-1] > 20 * n_words
                out.append((n_words, *rest, failed, not failed and score >= threshold, score))
            named = list(zip(*out, strict=True)) or [[]] * 8
            if carry:
                yield batch.filter(pa.array(named[6], pa.bool_()))
                continue
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(named, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCORES.split(", ")])

    picked = docs.select(*columns) if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(run, schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
