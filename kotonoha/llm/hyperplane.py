"""Hard negatives by a multiway tree of split points whose sibling subtrees are told apart by distance ranges.

Every vector gets one more coordinate that makes all of the same length, so a
window of inner products with an anchor is a ring of distances around it.  A
node of the tree has several split points; a vector belongs to the subtree of
the nearest.  For every split point and every sibling subtree the tree knows the least
and greatest distance between them, over all rows.  An anchor's distance to a split point and the
ring's radii tell at which distances from that point the ring's vectors can
lie; a sibling whose range does not meet them is passed over.  Leaves are
compared exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from kotonoha.llm.common import quoted, ship
from kotonoha.session import cut_lineage

#: Rows with components above this in size take no part: products of 8,000 of them still add up exactly in doubles.
LARGEST = 1 << 20

#: What rounding may add to or take from a distance.
SLACK = 1e-6


@dataclass(frozen=True)
class Mining:
    """The tree is built of ``sample`` rows at most, with ``ways`` split points a node, down to ``leaf`` of them; the
    rows of a leaf are compared in blocks of ``block``.  A negative's score lies between ``low`` and ``high``
    per cent of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    anchors: int = 100
    sample: int = 4096
    ways: int = 8
    leaf: int = 64
    block: int = 8192


@dataclass
class Node:
    """Split points with a subtree each; without any, a leaf."""

    points: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    number: int = -1
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def integer_rows(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, v of the rows that take part, v the components times 256, rounded down.

    Rows with a null id, label or vector, with a null or non-finite component, or with one
    above 2^20 once multiplied take no part.  The label of every id divisible by 7 is moved on by one, modulo 10.
    """
    x = quoted(vector_col)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * 256))
    rows = df.select(quoted(id_col).cast("long").alias("vec_id"), quoted(label_col).cast("long").alias("label"), x.alias("x"),
                     whole.alias("v"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * 256 <= LARGEST))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.col("v").cast("array<int>").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter ones are filled with zeros."""
    lists = column if isinstance(column, pa.ListArray) else column.cast(pa.list_(pa.int32()))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    if len(values) == out.size:
        out[:] = values.reshape(out.shape)
    else:
        ends = np.cumsum(sizes)
        out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = values
    return out


def lifted(v: np.ndarray, square: float) -> np.ndarray:
    """Vectors with one more coordinate, all of the squared length ``square``."""
    rest = np.sqrt(np.maximum(square - (v * v).sum(1), 0))
    return np.hstack([v, rest[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of ``a`` to all of ``b``; integers up to the last coordinate, so near ones lose little."""
    out = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(out, 0))


def grow(points: np.ndarray, settings: Mining, leaves: list[Node]) -> Node:
    """A tree over the sample: split points far from each other, the sample dealt to the nearest."""
    node = Node()
    if len(points) > settings.leaf:
        chosen = [int(np.argmax(distances(points, points.mean(0, keepdims=True))))]
        far = distances(points, points[chosen])[:, 0]
        while len(chosen) < settings.ways and far.max() > 0:
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, distances(points, points[chosen[-1:]])[:, 0])
        if len(chosen) > 1:
            node.points = points[chosen]
            nearest = distances(points, node.points).argmin(1)
            node.children = [grow(points[nearest == i], settings, leaves) if (nearest == i).sum() < len(points) else leaf(leaves)
                             for i in range(len(chosen))]
            return node
    return leaf(leaves, node)


def leaf(leaves: list[Node], node: Node | None = None) -> Node:
    node = node or Node()
    node.number = len(leaves)
    leaves.append(node)
    return node


def route(node: Node, v: np.ndarray, rows: np.ndarray, out: np.ndarray, seen: dict | None = None) -> None:
    """Writes the leaf of each of ``rows`` to ``out``; ``seen`` gathers the ranges met, by node."""
    if node.points is None:
        out[rows] = node.number
        return
    apart = distances(v[rows], node.points)
    nearest = apart.argmin(1)
    if seen is not None:
        low, high = seen.setdefault(id(node), (np.full((len(node.points),) * 2, np.inf), np.full((len(node.points),) * 2, -np.inf)))
    for j, child in enumerate(node.children):
        mine = nearest == j
        if mine.any():
            if seen is not None:
                low[:, j] = np.minimum(low[:, j], apart[mine].min(0))
                high[:, j] = np.maximum(high[:, j], apart[mine].max(0))
            route(child, v, rows[mine], out, seen)


def inner_nodes(node: Node) -> list[Node]:
    return [] if node.points is None else [node] + [n for c in node.children for n in inner_nodes(c)]


def survivors(node: Node, q: np.ndarray, near: np.ndarray, far: np.ndarray, rows: np.ndarray, out: list) -> None:
    """(rows, leaf) of all leaves that may hold a vector between ``near`` and ``far`` of an anchor, for any of its rings."""
    if node.points is None:
        out.append((rows, node.number))
        return
    to = distances(q[rows], node.points)[:, None, :, None]            # row, ring, split point, sibling
    inner, outer = near[rows][:, :, None, None], far[rows][:, :, None, None]
    low, high = node.low - SLACK, node.high + SLACK
    meets = (np.maximum(low, to - outer) <= np.minimum(high, to + outer)) & (to + high >= inner)
    alive = meets.all(2).any(1)
    for j, child in enumerate(node.children):
        left = rows[alive[:, j]]
        if len(left):
            survivors(child, q, near, far, left, out)


@dataclass
class Tree:
    """The tree, how many leaves it has, the width of vectors, their common squared length, and the sampled rows."""

    root: Node
    leaves: int
    width: int
    square: float
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def plant(rows: DataFrame, settings: Mining) -> Tree:
    """A tree of the bounded sample: the rows whose id has the smallest hashes."""
    most = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c))).head()
    width, square = int(most[0] or 0), float(most[1] or 0)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(settings.sample).collect()
    vectors = matrix(pa.array([r["v"] for r in picked], pa.list_(pa.int32())), width)
    leaves: list[Node] = []
    root = grow(lifted(vectors, square), settings, leaves)
    return Tree(root, len(leaves), width, square, np.array([r["vec_id"] for r in picked], np.int64),
                np.array([r["label"] for r in picked], np.int64), vectors)


def dealt(rows: DataFrame, tree: Tree) -> DataFrame:
    """The rows with their leaf and a number within the task that spreads a leaf's rows over blocks."""
    ship(rows.sparkSession.sparkContext)
    schema = T.StructType([*rows.schema.fields, T.StructField("leaf", T.IntegerType()), T.StructField("slot", T.LongType())])
    arrow = to_arrow_schema(schema)
    vector = rows.schema.fieldNames().index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int32)
            route(tree.root, lifted(matrix(batch.column(vector), tree.width), tree.square), np.arange(batch.num_rows), found)
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(arrow.field(i).type) for i in range(batch.num_columns)]
                                             + [pa.array(found), pa.array(np.arange(at, at + batch.num_rows))], schema=arrow)
            at += batch.num_rows

    return rows.mapInArrow(run, schema)


def measure(rows: DataFrame, tree: Tree) -> None:
    """Sets the distance ranges of the tree's nodes, from all rows.  What a task returns is bounded by the tree."""
    nodes = inner_nodes(tree.root)
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("node", "point", "sibling")]
                          + [T.StructField(c, T.DoubleType()) for c in ("low", "high")])
    vector = rows.schema.fieldNames().index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            route(tree.root, lifted(matrix(batch.column(vector), tree.width), tree.square), np.arange(batch.num_rows),
                  np.zeros(batch.num_rows, np.int32), seen)
        for number, node in enumerate(inner_nodes(tree.root)):
            if id(node) in seen:
                low, high = seen[id(node)]
                point, sibling = np.nonzero(np.isfinite(low))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(point), number, np.int32)), pa.array(point.astype(np.int32)),
                     pa.array(sibling.astype(np.int32)), pa.array(low[point, sibling]), pa.array(high[point, sibling])],
                    names=["node", "point", "sibling", "low", "high"])

    for node in nodes:
        node.low, node.high = (np.full((len(node.points),) * 2, x) for x in (np.inf, -np.inf))
    ranges = rows.mapInArrow(run, schema).groupBy("node", "point", "sibling").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in ranges.collect():
        nodes[r["node"]].low[r["point"], r["sibling"]] = r["low"]
        nodes[r["node"]].high[r["point"], r["sibling"]] = r["high"]


def first(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``n`` fitting columns of every row, by falling score, then by id."""
    row, column = np.nonzero(fits)
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    begin = np.searchsorted(row, row, side="left")
    few = np.arange(len(row)) - begin < n
    return row[few], column[few]


def least_score(scores: np.ndarray, fits: np.ndarray, n: int, floor: np.ndarray) -> np.ndarray:
    """The n-th best fitting score of every row, or its floor if fewer fit."""
    if scores.shape[1] < n:
        return floor
    kth = np.partition(np.where(fits, scores, -np.inf), scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    return np.maximum(kth, floor)


def asked(anchors: DataFrame, tree: Tree, settings: Mining, positives: bool) -> DataFrame:
    """Anchors with their windows of scores, once for every leaf that may hold one of their rows.

    A window's lower end is raised to the score of the n-th best row that the
    sample already has in it, so no row among the first n is lost.
    """
    schema = T.StructType([*anchors.schema.fields, T.StructField("leaf", T.IntegerType()),
                           T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)
    names = anchors.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                q = matrix(batch.column(names.index("v")), tree.width)
                ids, labels = (batch.column(names.index(c)).to_numpy() for c in ("vec_id", "label"))
                scores, alike = q @ tree.vectors.T, labels[:, None] == tree.labels
                if positives:
                    none = np.full(len(q), -np.inf)
                    low = least_score(scores, alike & (ids[:, None] != tree.ids), settings.positives, none)[:, None]
                    high = np.full_like(low, np.inf)
                else:
                    low, high = windows(batch.column(names.index("positives")), settings)
                    for w in range(low.shape[1]):
                        inside = ~alike & (scores >= low[:, w, None]) & (scores <= high[:, w, None])
                        low[:, w] = least_score(scores, inside, settings.negatives, low[:, w])
                # |q|^2 + square - 2 score is the squared distance to a vector of that score.
                base = (q * q).sum(1)[:, None] + tree.square
                ring = lambda score: np.sqrt(np.maximum(base - 2 * score, 0))
                near, far = ring(high) - SLACK, np.where(low <= high, ring(low) + SLACK, -np.inf)
                found: list = []
                survivors(tree.root, np.hstack([q, np.zeros((len(q), 1))]), near, far, np.arange(len(q)), found)
                if found:
                    row = np.concatenate([r for r, _ in found])
                    leaf = np.concatenate([np.full(len(r), n, np.int32) for r, n in found])
                    taken = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column(i).cast(arrow.field(i).type) for i in range(taken.num_columns)]
                        + [pa.array(leaf), *[pa.array(list(x[row]), arrow.field("low").type) for x in (low, high)]], schema=arrow)

    return anchors.mapInArrow(run, schema)


def windows(positives: pa.Array, settings: Mining) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the windows of negatives' scores, a column for each positive; empty where an anchor has fewer."""
    low = np.full((len(positives), settings.positives), np.inf)
    high = -low
    for i, scores in enumerate(positives.to_pylist()):
        for j, s in enumerate(scores):
            low[i, j], high[i, j] = -(-settings.low * s["score"] // 100), settings.high * s["score"] // 100
    return low, high


def met(rows: DataFrame, queries: DataFrame, blocks: DataFrame, tree: Tree, settings: Mining, positives: bool) -> DataFrame:
    """anchor, slot, score, vec_id: the first rows of each window within each block of a leaf.

    A block of rows and the anchors that ask for its leaf come to one task, rows
    first; the anchors pass by in batches, so only the block is held.
    """
    ship(rows.sparkSession.sparkContext)
    kept = ["vec_id", "label", "v"]
    placed = (rows.join(F.broadcast(blocks), "leaf")  # one row a leaf, and the tree bounds the leaves
              .withColumn("block", F.pmod(F.xxhash64("slot", "vec_id"), F.col("blocks"))))
    ends = [F.array().cast("array<double>").alias(c) for c in ("low", "high")]
    held = placed.select("leaf", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("anchor"), *kept, *ends)
    sent = queries.join(F.broadcast(blocks), "leaf").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("leaf", "block", F.lit(1).alias("kind"), "anchor", *kept, "low", "high")
    both = held.unionByName(sent).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind")
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("slot", T.IntegerType()),
                           T.StructField("score", T.LongType()), T.StructField("vec_id", T.LongType())])
    arrow = to_arrow_schema(schema)
    n = settings.positives if positives else settings.negatives

    def compare(block: tuple, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, labels, v = block
        q = matrix(batch.column("v"), tree.width)
        scores = q @ v.T
        anchor = batch.column("anchor").to_numpy()
        alike = batch.column("label").to_numpy()[:, None] == labels
        low, high = (np.array(batch.column(c).to_pylist(), float) for c in ("low", "high"))
        rest = alike & (batch.column("vec_id").to_numpy()[:, None] != ids) if positives else ~alike
        for w in range(low.shape[1]):
            fits = rest & (scores >= low[:, w, None]) & (scores <= high[:, w, None])
            if positives:  # a label of few sampled rows leaves the window open
                fits &= scores >= least_score(scores, fits, n, np.full(len(q), -np.inf))[:, None]
            row, column = first(scores, ids, fits, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[row]), pa.array(np.full(len(row), w, np.int32)),
                 pa.array(scores[row, column].astype(np.int64)), pa.array(ids[column])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, labels, v, block = None, [], [], [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("leaf", "block", "kind")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(key)]):
                part = batch.slice(a, b - a)
                place = tuple(key[a, :2])
                if place != now:
                    now, ids, labels, v, block = place, [], [], [], None
                if key[a, 2] == 0:
                    ids.append(part.column("vec_id").to_numpy())
                    labels.append(part.column("label").to_numpy())
                    v.append(matrix(part.column("v"), tree.width))
                    continue
                if block is None and ids:
                    block = np.concatenate(ids), np.concatenate(labels), np.concatenate(v)
                for at in range(0, part.num_rows if block else 0, 128):
                    yield from compare(block, part.slice(at, 128))

    return both.mapInArrow(run, schema)


def best(found: DataFrame, n: int) -> DataFrame:
    """The first n rows of every anchor and slot, with their rank; cut where they are found, then together."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(df: DataFrame, settings: Mining = Mining(), id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    Which rows take part is said at ``integer_rows``.  Anchors are those whose id
    is divisible by ``anchors``; positives are the first other rows of the
    label, negatives the first rows of other labels within the positive's window, by
    falling score, then by smaller id.  Shorter vectors are filled with zeros.
    A row that repeats an anchor's id is never its positive; other repeated rows
    count each; a repeated anchor asks once.  A table without anchors, an anchor without
    positives or a window without rows gives no rows.  Other columns are left out.
    """
    rows = cut_lineage(integer_rows(df, id_col, label_col, vector_col), "vectors")
    tree = plant(rows, settings)
    rows = cut_lineage(dealt(rows, tree), "leaves")
    measure(rows, tree)
    blocks = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / settings.block).cast("long").alias("blocks"))
    blocks = cut_lineage(blocks, "blocks")
    anchors = rows.where(F.col("vec_id") % settings.anchors == 0).select("vec_id", "label", "v").dropDuplicates()
    anchors = cut_lineage(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    asking = anchors.select("anchor", "vec_id", "label", "v")
    near = best(met(rows, asked(asking, tree, settings, True), blocks, tree, settings, True), settings.positives)
    # Five rows an anchor at most, in the order of their ranks.
    near = cut_lineage(near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("positives")),
                       "positives")
    asking = asking.join(near, "anchor")
    hard = best(met(rows, asked(asking, tree, settings, False), blocks, tree, settings, False), settings.negatives)
    named = asking.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("slot", "p"))
    return hard.join(named, ["anchor", "slot"]).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def oracle(settings: Mining = Mining()) -> str:
    """The same in SQL for the table of embeddings, every anchor against every row."""
    return f"""
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % {settings.anchors} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {settings.positives}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.alike
    AND {settings.low} * positive_score <= 100 * s.score AND 100 * s.score <= {settings.high} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {settings.negatives}"""
