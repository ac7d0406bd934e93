"""Near-duplicate groups by an LSH forest (operator 7).

Texts become sets of hashed word shingles; equal sets are one node. Each node has a signature of minimum hashes, and each
tree of the forest sorts the nodes by another rotation of it. Neighbours in a tree are nodes with a long common prefix:
all that share ROOT values form a region, and a region of more than BLOCK nodes is entered deeper until its parts are
small, so depth adapts to how crowded each region is. What shares even the longest prefix is cut into blocks that have
one node in common. Blocks are compared on full sets, a few trees at a time: after each round the components so far
are computed, and a block whose nodes are all in one component is not compared again. A group of thousands of near
copies so costs blocks, not pairs.

Nothing is lost to crowding: when the trees are through, nodes of regions that were entered deeper and still hold several
components are compared once more wherever they share a rare shingle, of which two linked sets always have one in common.
Texts that share only what many have, such as boilerplate, so are never compared pair by pair.
A link of similarity 0.8 is thus found unless no tree has it in one region: (1 - 0.8**4)**24, about 3 in a million. Within a block, full
sets are compared if the signatures agree on at least as many values as seven deviations below the similarity.

Defined cases: null or empty text has an empty set, n_shingles 0, and is its own component; rows that repeat a doc_id
are one node with all their links; a null doc_id is linked with nothing, has a null component and is kept; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, scratch, table

TREES = 24
ROOT = 4
#: Depths at which a crowded region is cut further.
DEPTHS = (6, 9, 12)
BLOCK = 64
#: Of groups of nodes that share a rare shingle, and of rareness: 2 ** RARE_BITS hash buckets are counted.
REST_BLOCK = 256
RARE_BITS = 20
ROUNDS = ((0,), (1, 2, 3), tuple(range(4, TREES)))
#: Tables of node numbers are broadcast up to this many rows (24 bytes each).
BROADCAST_NODES = 400_000
HASHES = TREES * ROOT
FACTORS = (np.random.default_rng(7).integers(0, 2**63, HASHES, np.uint64) << np.uint64(1)) | np.uint64(1)
PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    code = np.full(n, width, np.uint64)
    for k in range(width):
        code = (code ^ codes[k : k + n]) * PRIME
        code ^= code >> np.uint64(29)
    return np.unique(code)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * FACTORS[None, :]).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, same (a 128-bit digest of the set), values (the signature, 4 bytes a value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), width, hashes)
                out.append((len(shingles), xxhash.xxh128_digest(shingles.tobytes()), signature(shingles).tobytes()))
            n, same, values = zip(*out, strict=True) if out else ([], [], [])
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "same", "values"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, same binary, values binary")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, shingles (8 bytes each) of the given nodes, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text.as_py(), width, hashes).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        maybe_broadcast(nodes, BROADCAST_NODES), F.col("doc_id") == F.col("node"), "left_semi"
    )
    return chosen.mapInArrow(run, "node long, shingles binary")


def regions(nodes: DataFrame) -> DataFrame:
    """tree, node, path (the signature in the tree's order, as deep as DEPTHS goes), region, crowd: nodes that share a
    region with another node."""
    rows = nodes.select("node", "values", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    path = F.expr(f"substring(concat(values, values), tree * {4 * ROOT} + 1, {4 * DEPTHS[-1]})")
    rows = rows.select("tree", "node", path.alias("path"))
    rows = rows.withColumn("region", F.xxhash64("tree", F.substring("path", 1, 4 * ROOT)))
    crowds = rows.groupBy("region").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    return rows.join(crowds, "region")


def blocks(mates: DataFrame, block: int = BLOCK) -> DataFrame:
    """tree, block, node: at most block + 1 nodes in each block."""
    done = [mates.where(F.col("crowd") <= block).select("tree", F.col("region").alias("block"), "node")]
    rest = mates.where(F.col("crowd") > block).select("tree", "node", "path")
    for depth in DEPTHS:
        rest = rest.withColumn("block", F.xxhash64("tree", F.lit(depth), F.substring("path", 1, 4 * depth)))
        crowds = rest.groupBy("block").agg(F.count(F.lit(1)).alias("crowd"), F.min("node").alias("anchor")).where("crowd > 1")
        rest = rest.join(crowds, "block")
        done.append(rest.where(F.col("crowd") <= block).select("tree", "block", "node"))
        rest = rest.where(F.col("crowd") > block)
        rest = rest if depth == DEPTHS[-1] else rest.select("tree", "node", "path")
    part = lambda which: F.xxhash64("block", which)
    parts = F.ceil(F.col("crowd") / block).cast("int")
    done.append(rest.select("tree", part(F.pmod(F.xxhash64("node"), parts)).alias("block"), "node"))
    anchors = rest.select("tree", "block", "anchor", parts.alias("parts")).distinct()
    anchors = anchors.select("tree", "block", "anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("which"))
    done.append(anchors.select("tree", part(F.col("which")).alias("block"), F.col("anchor").alias("node")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between components that a block joins, at most one fewer than it has nodes.

    side 0 is compared with all others, sides 1 and 2 with each other only.
    """
    rows = rows.sort_values(["node", "comp"]).reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    root = {c: c for c in rows["comp"]}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    # Seven deviations below what two linked sets agree on: a first look that spares most comparisons of full sets.
    least = HASHES * percent / 100 - 7 * (HASHES * percent * (100 - percent) / 1e4) ** 0.5
    values = np.array([np.frombuffer(signature(x), ">u4") for x in sets])
    comps, sides, out = rows["comp"].tolist(), rows["side"].tolist(), []
    for i in range(1, len(sets)):
        for j in np.flatnonzero((values[:i] == values[i]).sum(axis=1) >= least).tolist():
            if sides[i] and sides[i] == sides[j]:
                continue
            a, b = find(comps[i]), find(comps[j])
            if a != b and linked(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                out.append((max(a, b), min(a, b)))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def compare(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, from rows (block, node, comp, side)."""
    apart = rows.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("block")
    rows = materialize(rows.join(apart, "block", "left_semi"), "compare")
    whole = sets.join(maybe_broadcast(rows, BROADCAST_NODES), "node")
    return whole.groupBy("block").applyInPandas(lambda pdf: block_links(pdf, percent), "a long, b long")


def star_step(edges: DataFrame) -> DataFrame:
    """One large star and one small star: nodes are hung on ever smaller neighbours, components stay the same."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("least"))
    small = large.join(lowest, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return small.unionByName(lowest.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def is_forest(edges: DataFrame) -> bool:
    """Whether each node hangs on one other, on which nothing else hangs: the components are then known."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return degrees.where("up > 1 OR (up = 1 AND down = 1)").limit(1).count() == 0


def star_forest(links: DataFrame) -> DataFrame:
    """a, b: each linked node with the smallest node reachable, which itself is no a."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(star_step(edges), "stars")
    while not is_forest(edges):
        edges = materialize(star_step(edges), "stars")
    return edges


def members(forest: DataFrame) -> DataFrame:
    """node, comp of each node of a forest, roots included."""
    roots = forest.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return forest.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of each node that has a link."""
    return members(star_forest(links))


def with_component(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(maybe_broadcast(comps, BROADCAST_NODES), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def crowded_nodes(mates: DataFrame, comps: DataFrame | None, block: int = BLOCK) -> DataFrame:
    """node, comp of the nodes of crowded regions that hold several components."""
    rows = with_component(mates.where(F.col("crowd") > block).select("region", "node"), comps)
    apart = rows.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("region")
    return rows.join(apart, "region", "left_semi").select("node", "comp").distinct()


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """node, token: of each set the rarest shingles, as many as that two linked sets have one of them in common.

    A set of n shingles shares at least percent * n / 100 with one it is linked to, so one of any n less that and one
    more. Rareness is that of hash buckets, of which there is a bounded number; any one order would do.
    """
    bucket = np.uint64(64 - RARE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << RARE_BITS, np.int64)
        for batch in batches:
            for data in batch.column(1):
                n += np.bincount((np.frombuffer(data.as_py(), np.uint64) >> bucket).astype(np.int64), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    found = sets.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << RARE_BITS, np.int64)
    often[found.column(0).to_numpy()] = found.column(1).to_numpy()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, tokens = [], [np.zeros(0, np.uint64)]
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(data.as_py(), np.uint64)
                most = len(own) - -(-percent * len(own) // 100) + 1
                tokens.append(own[np.lexsort((own, often[(own >> bucket).astype(np.int64)]))[:most]])
                nodes += [node] * len(tokens[-1])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(tokens).view(np.int64))], names=["node", "token"])

    return sets.mapInArrow(pick, "node long, token long")


def crowded_rest(nodes: DataFrame, sets: DataFrame, percent: int, part: int = REST_BLOCK) -> DataFrame:
    """Blocks that compare the nodes of crowded regions wherever they may still be linked: those that have a rare
    shingle in common. Groups of the same nodes are one. In a group of more than part nodes, those outside its main
    component are compared with the whole group: both are dealt into parts, and each pair of parts is a block."""
    own_sets = sets.join(maybe_broadcast(nodes.select("node"), BROADCAST_NODES), "node", "left_semi")
    rows = materialize(rare_shingles(own_sets, percent).join(maybe_broadcast(nodes, BROADCAST_NODES), "node"), "rare")
    own = F.xxhash64("node")
    each = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(own).alias("x"), F.bit_xor(F.xxhash64(own)).alias("y"))
    groups = each.groupBy("token").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
    ).where("comps > 1")
    groups = groups.groupBy("n", "x", "y").agg(F.min(F.struct("token", "main")).alias("one")).select(F.col("one.token").alias("token"), F.col("one.main").alias("main"), "n")
    wide, high = (F.ceil(x / part).cast("long") for x in (F.col("n"), F.col("n") - F.col("main.n")))
    groups = groups.select("token", (F.col("n") <= part).alias("small"), F.col("main.comp").alias("main"), wide.alias("wide"), high.alias("high"))
    rows = materialize(rows.join(groups, "token"), "rare")
    deal = lambda parts: F.pmod(own, F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    large = rows.where("NOT small")
    left = large.where("comp <> main").select("token", "node", "comp", deal("high").alias("i"), every("wide").alias("j"), F.lit(1).alias("side"))
    right = large.select("token", "node", "comp", every("high").alias("i"), deal("wide").alias("j"), F.lit(2).alias("side"))
    both = left.unionByName(right).select(F.xxhash64("token", "i", "j").alias("block"), "node", "comp", "side")
    return rows.where("small").select(F.col("token").alias("block"), "node", "comp", F.lit(0).alias("side")).unionByName(both)


def near_components(docs: DataFrame, found: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """node, comp of all that is linked."""
    real = found.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = real.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("values").alias("values"))
    nodes = materialize(nodes, "nodes")
    # Rows that repeat a doc_id, and copies, hang on the node of their set.
    copies = real.select("same", "doc_id").join(nodes.select("same", "node"), "same").where("doc_id <> node")
    copies = copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    mates = materialize(regions(nodes), "mates")
    dealt = materialize(blocks(mates, block), "blocks")
    # Of all mates: a node alone at a deeper depth is in no block, but may be compared with its whole region at the end.
    sets = materialize(full_sets(docs, mates.select("node").distinct(), width), "sets")
    # The forest so far stands for the links of the rounds before.
    forest, comps = None, None
    for trees in ROUNDS:
        rows = with_component(dealt.where(F.col("tree").isin(*trees)).select("block", "node"), comps)
        new = materialize(compare(rows.withColumn("side", F.lit(0)), sets, percent), "found")
        forest = star_forest(new if forest is None else forest.unionByName(new))
        comps = members(forest)
    rest = materialize(crowded_nodes(mates, comps, block), "rest")
    if rest.limit(1).count():
        rest = materialize(crowded_rest(rest, sets, percent), "rest")
        forest = forest.unionByName(materialize(compare(rest, sets, percent), "found"))
    return components(forest.unionByName(copies))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    with scratch(docs.sparkSession):
        found = materialize(sketches(docs, width), "sketches")
        comps = materialize(near_components(docs, found, width, percent, block), "components", keep=True)
        found = materialize(found.select("doc_id", "n_shingles"), "sizes", keep=True)
    comps = comps.withColumnRenamed("node", "doc_id")
    out = found.join(maybe_broadcast(comps, BROADCAST_NODES), "doc_id", "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_dedup_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all columns of docs."""
    gone = near_groups(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_ml_gone")).distinct()
    gone = maybe_broadcast(materialize(gone, "gone"), BROADCAST_NODES)
    return docs.join(gone, F.col("doc_id") == F.col("_ml_gone"), "left_anti")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=4)
