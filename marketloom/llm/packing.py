"""Packing documents into sequences by sums of squares (operator 3).

Documents become token identifiers, an end identifier after each; only documents longer than a sequence are cut, so
that the first piece takes the remainder and all others are full. Full pieces are sequences of their own. The others
are dealt by hash into groups of about GROUP_PIECES, and each group is packed on its own: a piece goes where the sum,
over residual gaps, of the squared number of open bins with that gap becomes smallest (a new bin is one of the choices).
When a group ends, its bins that still have a gap are opened again, with up to a quarter of the full ones, and their
pieces placed in falling order of length, each into the smallest gap that holds it; the method's open bins would
otherwise stay part empty (4 % more sequences than the bound at this group size, against 0.1 to 1 % after it). Each
piece says whether its sequence came through the sums of squares (by_squares).

Defined cases: null or empty text is the end identifier alone; texts of any length, and runs of space in them, are encoded whole; null doc_id is carried; repeated rows are packed each;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

CAPACITY = 1024
END_ID = 2
GROUP_PIECES = 8192
#: Shares of a group's full bins, those of most pieces, that are opened again with the bins that have a gap.
REOPENED = (0.0, 0.05, 0.1, 0.25)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(ranks_path: str, pattern: str, tokenizer_path: str, special: bool = True):
    """The byte-level BPE of the vocabulary file. Names of special tokens in a text are their identifiers, as the
    tokenizer file's own library has it, or ordinary text if special is false. That library also takes the texts that the
    faster one gives up: runs of about a million spaces exceed what its patterns may keep in mind."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(tokenizer_path, encoding="utf-8") as file:
        plain = json.load(file)
    added = {x["content"]: x["id"] for x in plain["added_tokens"]} if special else {}
    encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    slow = None

    def encode(text: str) -> list[int]:
        nonlocal slow
        try:
            return encoding.encode(text, allowed_special="all", disallowed_special=())
        except ValueError as problem:
            if "Regex error" not in str(problem):
                raise
        if slow is None:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_str(json.dumps(plain | {"added_tokens": plain["added_tokens"] if special else []}))
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece; the first takes the remainder."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece. The vocabulary and the tokenizer, with its special tokens, are read from the tokenizer package's own
    files on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, public_tokenizers.path(tokenizer))
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), end_id], "<u4")
                out.extend((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids), capacity)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each piece, taken in the order given.

    With N(g) open bins of gap g, moving one bin from gap g to g - s changes the sum of squares by
    2 (N(g - s) - N(g)) + 2, filling it up by 1 - 2 N(g), and a new bin by 2 N(capacity - s) + 1.
    """
    open_by_gap = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, used = np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(map(int, lengths)):
        best, at = 2 * open_by_gap[capacity - s] * (s < capacity) + 1, None
        gaps = open_by_gap[s:capacity]
        if gaps.any():
            change = 2 * (open_by_gap[: capacity - s] - gaps) + 2
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
            if change[k] <= best:
                at = s + k
        if at is None:
            where, used, at = used, used + 1, capacity
        else:
            where = stacks[at].pop()
            open_by_gap[at] -= 1
        if at > s:
            stacks[at - s].append(where)
            open_by_gap[at - s] += 1
        bins[i] = where
    return bins


def best_fit_falling(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each piece, the longest placed first and each into the smallest gap that holds it."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = np.zeros(capacity + 1, bool)
    bins, used = np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        k = int(has[s:].argmax()) if s <= capacity else 0
        if has[s + k]:
            where, at = stacks[s + k].pop(), s + k
            has[at] = bool(stacks[at])
        else:
            where, used, at = used, used + 1, capacity
        if at > s:
            stacks[at - s].append(where)
            has[at - s] = True
        bins[i] = where
    return bins


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bins by sums of squares; those with a gap at the end, and the best of some shares of full ones, packed anew.
    With them, whether each piece's bin is one of the former."""
    bins = sum_of_squares(lengths, capacity)
    if not len(bins):
        return bins, np.zeros(0, bool)
    full = np.bincount(bins, weights=lengths) >= capacity
    pieces = np.bincount(bins)
    by_pieces = np.flatnonzero(full)[np.argsort(-pieces[full], kind="stable")]
    best, least, fresh = bins, len(full), np.zeros(len(bins), bool)
    for share in REOPENED:
        left = ~full
        left[by_pieces[: int(share * len(by_pieces))]] = True
        again = best_fit_falling(lengths[left[bins]], capacity)
        used = int((~left).sum()) + (int(again.max()) + 1 if len(again) else 0)
        if used < least:
            best, least, fresh = bins.copy(), used, left[bins]
            best[fresh] = again + len(full)
    return np.unique(best, return_inverse=True)[1], ~fresh


def pack_group(rows: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    rows = rows.sort_values(["order", "doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
    bins, by_squares = pack_lengths(rows["length"].to_numpy(), capacity)
    order = np.argsort(bins, kind="stable")
    rows, bins = rows.iloc[order].reset_index(drop=True), bins[order]
    rows["by_squares"] = by_squares[order]
    ends = rows["length"].cumsum() - rows["length"]
    rows["offset"] = ends - ends.groupby(bins).transform("min")
    rows["sequence_id"] = rows["part"].astype("int64") * 2**32 + bins
    return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "by_squares"]]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, **tokens) -> DataFrame:
    """One row per piece with its sequence_id and offset. Sequences of one full piece have negative numbers."""
    pieces = materialize(token_pieces(docs, capacity=capacity, **tokens), "pieces")
    short = pieces.where(F.col("length") < capacity)
    groups = -(-max(1, short.count()) // group_pieces)
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    short = short.withColumns({"order": order, "part": F.pmod(F.xxhash64(order), F.lit(groups)).cast("int")})
    packed = short.groupBy("part").applyInPandas(lambda rows: pack_group(rows, capacity), f"{PIECES}, sequence_id long, offset long, by_squares boolean")
    full = pieces.where(F.col("length") >= capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "by_squares": F.lit(True)}
    )
    return packed.unionByName(full)


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
