"""Near-duplicate sets of word shingles: an exact Jaccard join by partition-and-enumerate signatures."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kotonoha.llm.common import map_rows, quoted, ship
from kotonoha.llm.components import components
from kotonoha.session import cut_lineage


@dataclass(frozen=True)
class Join:
    """Sets of ``size`` words link when 100 * intersection >= ``percent`` * union.

    Sizes fall into bands whose ends differ by the factor ``band``.  ``subset``
    second-level partitions make up a signature, and a first-level one may hold
    ``apart`` shingles of only one set.  There are ``slack`` times the partitions
    needed.  Texts are compared in blocks of
    about ``block`` texts and ``block_shingles`` shingles, those that share a
    signature in buckets of up to ``bucket`` sets.
    """

    size: int = 3
    percent: int = 90
    band: float = 1.5
    subset: int = 1
    apart: int = 0
    slack: float = 1.3
    block: int = 3000
    block_shingles: int = 1_500_000
    bucket: int = 2000


#: Odd numbers without meaning, as bases and mixers of 64-bit hashes.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MIX_A, MIX_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = x ^ x >> U(33)
    x = x * U(MIX_A)
    x = x ^ x >> U(33)
    x = x * U(MIX_B)
    return x ^ x >> U(33)


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, below 2 ** 64."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes.

    Words end at ASCII white space, A-Z count as lower case.  A shingle's hash is
    made from two polynomial hashes of its words joined by blanks, which come
    from running sums over the text.  Fewer words than ``size`` make one shingle.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) > size:
        starts, ends = starts[:len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    out = (ends - starts).astype(np.uint64)
    room = 1 << max(12, (len(data) + 1).bit_length())
    for base in (BASE_A, BASE_B):
        up, down = powers(base, room)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + U(1)) * up[:len(data)], out=total[1:])
        out = mixed(out ^ (total[ends] - total[starts]) * down[starts])
    return np.unique(out)


def digest(found: np.ndarray) -> int:
    """A signed 64-bit number of a set."""
    total = mixed(np.array([mixed(found).sum(dtype=np.uint64) + U(len(found))], np.uint64))
    return int(total.view(np.int64)[0])


def bands(n: int, join: Join) -> list[int]:
    """Bands whose signatures a set of n shingles needs: its own, and the next
    one if a set there can be similar enough."""
    own = int(math.log(n) / math.log(join.band) + 1e-9)
    while lowest(own + 1, join) <= n:
        own += 1
    while lowest(own, join) > n:
        own -= 1
    return [own, own + 1] if 100 * n >= join.percent * lowest(own + 1, join) else [own]


def lowest(band: int, join: Join) -> int:
    """The smallest size in a band."""
    return math.ceil(join.band ** band - 1e-9)


@lru_cache(maxsize=256)
def plan(band: int, join: Join) -> tuple[int, int, int, tuple]:
    """(first-level partitions, those that may be spoilt, second-level partitions of each, subsets of these).

    Of two linked sets whose larger one lies in the band, at most k shingles are
    in only one.  A first-level partition with at most ``apart`` of them has a
    subset of second-level partitions that is equal in both; the others are
    spoilt.  There are ``slack`` times more partitions than may be spoilt.
    """
    largest = lowest(band + 1, join) - 1
    k = 2 * largest * (100 - join.percent) // (100 + join.percent)
    apart = min(k, join.apart)
    spoilt = k // (apart + 1)
    second = apart + join.subset
    return math.ceil((spoilt + 1) * join.slack), spoilt, second, tuple(combinations(range(second), join.subset))


def cells(found: np.ndarray, join: Join) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each band of a set, the hash of the shingles in every second-level partition, a row per first-level one, and their number."""
    if not len(found):
        return {}
    share, value = mixed(found ^ U(BASE_A)) >> U(32), mixed(found + U(BASE_B))
    out = {}
    for band in bands(len(found), join):
        first, _, second, _ = plan(band, join)
        part = (share * U(first * second) >> U(32)).astype(np.int64)  # equal shares of the hashes
        sums = np.zeros(first * second, np.uint64)
        np.add.at(sums, part, value)
        out[band] = sums.reshape(first, second), np.bincount(part, minlength=first * second).reshape(first, second)
    return out


def profiles(found: np.ndarray, join: Join, parted: dict | None = None) -> list[dict]:
    """A byte of each second-level partition's hash, for each band of a set; ``parted`` are its ``cells`` if known.

    Partitions whose bytes differ hold a shingle of only one set, so two sets
    that link differ in no more bytes than they may in shingles.
    """
    return [{"band": band, "cells": (mixed(sums.ravel()) >> U(56)).astype(np.uint8).tobytes()}
            for band, (sums, _) in (parted or cells(found, join)).items()]


def signatures(found: np.ndarray, join: Join, parted: dict | None = None) -> np.ndarray:
    """Signed 64-bit signatures of a set, distinct; the last six bits are those of the band; ``parted`` as above.

    Linked sets agree in a subset of all first-level partitions but the spoilt
    ones.  Let every set rank its subsets by their shingles, the most first, then
    by their hash: a rank that depends on nothing else.  Two sets that agree in all but
    ``spoilt`` partitions also agree in one of the first ``spoilt + 1`` subsets by
    this rank of each kind, so the rest is not needed.  What is left out is empty
    or small, and would bring unlike sets together.
    """
    out = [np.zeros(0, np.uint64)]
    for band, (sums, filled) in (parted or cells(found, join)).items():
        first, spoilt, _, subsets = plan(band, join)
        place = np.arange(first, dtype=np.uint64) * U(len(subsets)) + U(band << 40)
        values, sizes = [], []
        for i, subset in enumerate(subsets):
            value = place + U(i)
            for j in subset:
                value = mixed(value ^ sums[:, j])
            values.append(value)
            sizes.append(filled[:, list(subset)].sum(1))
        values, sizes = np.concatenate(values), np.concatenate(sizes)
        # All but so many subsets can differ between linked sets.
        most = spoilt * len(subsets) + (first - spoilt) * (len(subsets) - 1)
        out.append(values[np.lexsort((values, -sizes))[:most + 1]] & ~U(63) | U(band & 63))
    return np.unique(np.concatenate(out)).view(np.int64)


def described(df: DataFrame, join: Join, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns ``keep``, n_shingles, node (a digest of the set, null if it is empty), profiles and signatures of
    every row; a task gives the last two of equal sets once, then null."""
    def make():
        seen: set[int] = set()

        def row(text):
            found = shingles(text or "", join.size)
            node = digest(found) if len(found) else None
            if node is None or node in seen:
                return len(found), node, None, None
            seen.add(node)
            parted = cells(found, join)
            return len(found), node, profiles(found, join, parted), signatures(found, join, parted)

        return row

    profile = T.StructType([T.StructField("band", T.IntegerType()), T.StructField("cells", T.BinaryType())])
    return map_rows(df, make, [text_col], [id_col, *keep], [
        T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("profiles", T.ArrayType(profile)), T.StructField("signatures", T.ArrayType(T.LongType()))])


def alike(sizes: np.ndarray, seen: np.ndarray, join: Join) -> list[tuple[int, int]]:
    """Pairs of a bucket's sets that connect all whose profiles differ in no more bytes than linked sets may."""
    root, out = np.arange(len(sizes)), []
    for i in range(len(sizes) - 1):
        rest = np.flatnonzero(root[i + 1:] != root[i]) + i + 1
        if not len(rest):
            continue
        differ = (seen[rest] != seen[i]).sum(1)
        for j in rest[(100 + join.percent) * differ <= (100 - join.percent) * (sizes[rest] + sizes[i])]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, int(j)))
    return out


def bucket_edges(members: DataFrame, join: Join) -> DataFrame:
    """u, v from (signature, node, n, cells): what connects a bucket's sets of alike profiles.

    A bucket's sets come one after another.  Up to ``bucket`` are compared by
    their profiles; the sets of a larger bucket are all joined to its first, so
    none is held and no link is lost.
    """
    ship(members.sparkSession.sparkContext)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(parts, "signature").sortWithinPartitions("signature", "node").select("signature", "node", "n", "cells")

    def edges(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    def run(batches):
        held, hub, nodes, sizes, seen, out = None, None, [], [], [], []

        def finish():
            if len(nodes) > 1:
                width = {len(x) for x in seen}
                compared = alike(np.array(sizes), np.frombuffer(b"".join(seen), np.uint8).reshape(len(seen), -1), join) \
                    if len(width) == 1 else [(0, j) for j in range(1, len(nodes))]
                out.extend((nodes[i], nodes[j]) for i, j in compared)

        for batch in batches:
            for signature, node, n, cells_ in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if signature != held:
                    finish()
                    held, hub, nodes, sizes, seen = signature, None, [], [], []
                if nodes and node == nodes[-1] or node == hub:
                    continue
                if hub is not None:
                    out.append((hub, node))
                    continue
                nodes.append(node)
                sizes.append(n)
                seen.append(cells_ or b"")
                if len(nodes) > join.bucket:
                    hub = nodes[0]
                    out.extend((hub, x) for x in nodes[1:])
                    nodes, sizes, seen = [], [], []
                if len(out) > 10_000:
                    yield edges(out)
                    out.clear()
        finish()
        yield edges(out)

    return dealt.mapInArrow(run, "u long, v long")


def telling_buckets(met: DataFrame) -> DataFrame:
    """signature, node, distinct, of one bucket for each set of members that buckets of a band have.

    Near copies meet in most of their signatures, and a bucket with the same
    members tells nothing new.  Members are told apart by their number and 128
    bits of hashes.
    """
    rows = met.distinct()
    same = [(F.col("signature").bitwiseAND(63)).alias("band"), F.count(F.lit(1)).alias("members"),
            *(F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"hash_{seed}") for seed in (1, 2))]
    of = rows.groupBy("signature").agg(*same[1:]).select("signature", same[0], "members", "hash_1", "hash_2")
    chosen = of.groupBy("band", "members", "hash_1", "hash_2").agg(F.min("signature").alias("signature"))
    return rows.join(chosen.select("signature"), "signature")


def candidate_clusters(sets: DataFrame, join: Join) -> DataFrame:
    """node, cluster: sets joined by shared signatures and alike profiles; only such sets can link.

    Signatures are exchanged once; equal sets have been merged per task before.
    Only the rows of telling buckets with several sets get their profiles.
    """
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.select("node", F.explode("signatures").alias("signature"))
    # With the join's own conditions stated here, both uses below have one plan and share one exchange.
    dealt = rows.where("signature is not null and node is not null").repartition(n, "signature")
    shared = dealt.groupBy("signature").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    met = cut_lineage(dealt.join(shared.select("signature"), "signature"), "shared")
    met = cut_lineage(telling_buckets(met), "telling")
    known = sets.where("signatures is not null").select("node", F.struct("n_shingles", "profiles").alias("of"))
    known = known.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("of").alias("of"))
    own = F.filter("of.profiles", lambda p: p["band"].bitwiseAND(63) == F.col("signature").bitwiseAND(63))
    members = met.join(known, "node").select("signature", "node", F.col("of.n_shingles").alias("n"), own[0]["cells"].alias("cells"))
    edges = bucket_edges(members, join).distinct()
    return components(edges).select("node", F.col("root").alias("cluster"))


class Buckets:
    """Sets of one block by shared signatures."""

    def __init__(self, sets: list[np.ndarray], join: Join):
        given = [signatures(x, join) for x in sets]
        values, owners = np.concatenate(given), np.repeat(np.arange(len(sets)), [len(x) for x in given])
        order = np.argsort(values, kind="stable")
        values, self.owners = values[order], owners[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        ends = np.append(starts[1:], len(values))
        shared = ends - starts > 1
        self.starts, self.ends = starts[shared], ends[shared]
        of = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        holders = np.concatenate([self.owners[a:z] for a, z in zip(self.starts, self.ends)]) if len(of) else of
        order = np.argsort(holders, kind="stable")
        self.mine, self.cuts = of[order], np.searchsorted(holders[order], np.arange(len(sets) + 1))

    def partners(self, i: int) -> np.ndarray:
        """The sets that share a signature with set i, itself included; all sets where that is no less work."""
        runs = self.mine[self.cuts[i]:self.cuts[i + 1]]
        n = len(self.cuts) - 1
        if (self.ends[runs] - self.starts[runs]).sum() > 2 * n:
            return np.arange(n)
        return np.unique(np.concatenate([self.owners[self.starts[r]:self.ends[r]] for r in runs])) if len(runs) else runs


def links_of_block(nodes: list[int], blocks: list[int], sets: list[np.ndarray], join: Join) -> list[tuple[int, int]]:
    """Links that connect the sets of one block, or those of one block with another's.

    Each set is compared with the later ones that share a signature and are not
    in its component yet, by marking its shingles and counting marks in the others.
    """
    sizes = np.array([len(x) for x in sets])
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.append(0, np.cumsum(sizes)[:-1])
    mark = np.zeros(places.max() + 1, np.int32)
    root, side = np.arange(len(sets)), np.array(blocks)
    across = len(set(blocks)) > 1
    buckets = Buckets(sets, join)
    out = []
    for i in range(len(sets) - 1):
        near = buckets.partners(i)
        near = near[near > i]
        smaller, larger = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
        able = (100 * smaller >= join.percent * larger) & (root[near] != root[i])
        if across:
            able &= side[near] != side[i]
        near = near[able]
        if not len(near):
            continue
        own = places[starts[i]:starts[i] + sizes[i]]
        mark[own] = 1
        if 8 * len(near) > len(sets):
            shared = np.add.reduceat(mark[places], starts)[near]
        else:
            shared = np.array([mark[places[starts[j]:starts[j] + sizes[j]]].sum() for j in near])
        mark[own] = 0
        for j in near[100 * shared >= join.percent * (sizes[near] + sizes[i] - shared)]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((nodes[i], nodes[j]))
    return out


def links(texts: DataFrame, join: Join) -> DataFrame:
    """u, v: enough links to connect whatever is connected, from (cluster, block, other, node, text).

    A task holds one pair of blocks at a time.
    """
    ship(texts.sparkSession.sparkContext)
    unit = ["cluster", "low", "high"]
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(n, *unit).sortWithinPartitions(*unit).select(*unit, "block", "node", "text")

    def compare(batches):
        held, rows = None, []

        def finish():
            nodes, blocks, sets, seen = [], [], [], set()
            for block, node, text in rows:
                found = shingles(text, join.size)
                if len(found) and digest(found) == node and node not in seen:  # else another text of the same id
                    seen.add(node)
                    nodes.append(node)
                    blocks.append(block)
                    sets.append(found)
            pairs = links_of_block(nodes, blocks, sets, join) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for *key, block, node, text in zip(*columns):
                if key != held:
                    if len(rows) > 1:
                        yield finish()
                    held, rows = key, []
                rows.append((block, node, text))
        if len(rows) > 1:
            yield finish()

    return dealt.mapInArrow(compare, "u long, v long")


def grouped(df: DataFrame, join: Join, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, the columns ``keep``, n_shingles, node, component and keeper (the smallest id of what links reach, and the
    smallest of its sets there) of every row; no component or keeper where the set is empty."""
    sets = cut_lineage(described(df, join, id_col, text_col, keep).withColumnRenamed(id_col, "doc"), "sets")
    clusters = candidate_clusters(sets, join)
    sets = sets.drop("profiles", "signatures")
    firsts = (sets.where("node is not null and doc is not null").groupBy("node")
              .agg(F.min("doc").alias("doc"), F.max("n_shingles").alias("n")))
    members = cut_lineage(clusters.join(firsts, "node"), "members")
    sizes = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / join.block), F.ceil(F.sum("n") / join.block_shingles)).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    texts = df.select(quoted(id_col).alias("doc"), F.make_valid_utf8(quoted(text_col)).alias("text"))
    # Texts are exchanged once whatever the number of members, so the job behaves alike at every size.
    pairs = (texts.where("doc is not null").join(placed.hint("merge"), "doc").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))
    linked_nodes = components(links(pairs, join))
    roots = linked_nodes.join(firsts, "node").groupBy("root").agg(F.min(F.struct("doc", "node")).alias("first"))
    of_nodes = (firsts.join(linked_nodes, "node", "left").join(roots, "root", "left")
                .select("node", F.coalesce("first.doc", "doc").alias("component"), F.coalesce("first.node", "node").alias("keeper")))
    return sets.join(of_nodes, "node", "left")


def near_duplicates(df: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links, itself included) of every row.

    Sets are distinct shingles of ``size`` words; fewer words make one shingle; no
    words (or a null text) make an empty set that links with nothing.  Equal sets
    are one node and linked.  Texts with a shared signature form clusters; within
    a cluster the sets are compared exactly, large clusters in pairs of blocks of
    bounded size.  Rows without an id get no component.  Repeated rows give
    repeated rows; other columns are left out.  Sets and shingles are told apart
    by 64-bit hashes.
    """
    out = grouped(df, join, id_col, text_col)
    return out.select(F.col("doc").alias(id_col), "n_shingles", F.when(
        F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))


def keep_one(df: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: of the smallest id, and of its sets there the smallest digest.

    An id with several texts is judged text by text.  Of rows that share id and
    set the smallest hash of the text stays, and of those that repeat it any one.
    Rows without an id, and those of empty sets, which link with nothing, stay.
    """
    content = "_content"
    while content in df.columns:
        content += "_"
    keyed = df.withColumn(content, F.xxhash64(quoted(text_col)))
    texts = (grouped(keyed, join, id_col, text_col, (content,)).where("doc is not null and node is not null")
             .groupBy("doc", content, "node").agg(F.first("component").alias("component"), F.first("keeper").alias("keeper"),
                                                  F.count(F.lit(1)).alias("rows")))
    place = F.row_number().over(Window.partitionBy("doc", "node").orderBy(content))
    stays = (F.col("doc") == F.col("component")) & (F.col("node") == F.col("keeper")) & (place == 1)
    # Written, the tables have a known size, and are sent to the texts where they are small.
    judged = cut_lineage(texts.select("doc", F.col(content).alias("its_content"), "rows", stays.alias("stays"))
                         .where("not stays or rows > 1"), "judged")
    twice = cut_lineage(judged.where("stays").select("doc", "its_content"), "twice")

    def of(found: DataFrame, how: str) -> DataFrame:
        return keyed.join(found, (keyed[f"`{id_col}`"] == found["doc"]) & (keyed[content] == found["its_content"]), how)

    out = of(judged, "left_anti")
    if not twice.isEmpty():
        out = out.unionByName(of(twice, "left_semi").dropDuplicates([id_col, content]))
    return out.drop(content)
