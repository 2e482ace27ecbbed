"""Hard-negative mining over cover trees.

Candidates of unlike length get one more coordinate that makes all lengths equal (that of the longest one), so that a
larger inner product is a smaller distance. A cover tree's node holds the points within its radius of its centre;
children are centres further apart than their level's radius, which shrinks from level to level. From the product of an
anchor with a centre and the node's radius follow the least and the greatest product below the node.

The rows are dealt to cells around pivots, the top cover, large cells to several chunks by hash, and each chunk becomes
one row of a written index: its vectors in leaf order and its nodes. Anchors are taken in blocks, each broadcast; a task
goes through its chunks, keeps every anchor's best rows so far, descends level by level, leaves out nodes whose products
lie outside the anchor's window or below its last rank, and verifies leaves, the one of the greatest bound first, by
exact integer products. A first descent finds the positives, a second the negatives in the positives' windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.llm.stage import stage, stage_path

#: rows a chunk holds on average, pivots at most and the rows they are chosen from (by hash of the id)
CHUNK = 4096
CELLS = 1024
SAMPLE = 8192
#: points that make a leaf, and by how much a level's radius is smaller than its parent's
LEAF = 48
SHRINK = 1.4
#: anchors that are broadcast together, and that a task works on at a time
BLOCK = 1 << 14
PART = 128
#: scaled components beyond this could overflow a sum of products
LARGEST = float(1 << 24)
#: share of the squared lengths that bounds are widened by, for rounding
SLACK = 1e-6

_INDEX = {
    "vectors": np.int32, "ids": np.int64, "labels": np.int64, "centre": np.int64, "radius": np.float64, "child": np.int64,
    "rows": np.int64, "level": np.int64,
}


def scaled(rows: DataFrame, vector: str, scale: float) -> DataFrame:
    """vec_id, label and the components times ``scale``, rounded down, as little-endian 32-bit integers.

    Rows with a null id, label, vector or component, or with one that is not finite or, scaled, beyond 2**24, take no part.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            flat = lists.flatten()
            values = np.floor(np.asarray(flat.fill_null(np.nan), dtype=np.float64) * scale)
            # the comparison is false for what is not a number
            bad = np.concatenate([[0], np.cumsum(~(np.abs(values) <= LARGEST))])
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64))
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            keep = np.flatnonzero(bad[ends] == bad[starts])
            values = np.where(np.abs(values) <= LARGEST, values, 0).astype("<i4")
            made = [values[a:b].tobytes() for a, b in zip(starts[keep].tolist(), ends[keep].tolist())]
            taken = pa.array(keep)
            columns = [batch.column("vec_id").take(taken), batch.column("label").take(taken), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    named = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vec"),
    )
    return named.dropna().mapInArrow(run, "vec_id long, label long, vec binary")


def matrix(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """The vectors as rows of integers, shorter ones filled up with zeros, which add nothing to a product."""
    sizes = [len(v) // 4 for v in vectors]
    out = np.zeros((len(vectors), max([width, *sizes])), dtype=np.int32)
    if len(set(sizes)) == 1 and sizes[0] == out.shape[1]:
        return np.frombuffer(b"".join(vectors), dtype="<i4").reshape(out.shape)
    for row, v in zip(out, vectors):
        row[: len(v) // 4] = np.frombuffer(v, dtype="<i4")
    return out


def _fitted(m: np.ndarray, width: int) -> np.ndarray:
    """``m`` with ``width`` columns: zeros added, or columns the other side doesn't have left out."""
    if m.shape[1] >= width:
        return m[:, :width]
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """``number`` rows of the sample, each the one furthest from those before it."""
    points = sample.astype(np.float64)
    squares = (points**2).sum(axis=1)
    chosen, gap = [0], np.full(len(points), np.inf)
    while len(chosen) < min(number, len(points)):
        last = chosen[-1]
        gap = np.minimum(gap, squares + squares[last] - 2 * points @ points[last])
        chosen.append(int(gap.argmax()))
    return sample[chosen]


@dataclass
class Tree:
    """A cover tree over one chunk; nodes are numbered level by level, a node's children follow each other."""

    vectors: np.ndarray  #: of the rows, in leaf order
    ids: np.ndarray
    labels: np.ndarray
    centre: np.ndarray  #: of each node, the number of a row
    radius: np.ndarray  #: greatest distance of the node's points from its centre
    child: np.ndarray  #: first and last-plus-one child of each node; equal for a leaf
    rows: np.ndarray  #: first and last-plus-one row of each leaf
    level: np.ndarray  #: first node of each level; one more at the end
    longest: float  #: squared length of the longest vector

    @classmethod
    def read(cls, row: dict) -> Tree:
        parts = {k: np.frombuffer(row[k], dtype=t) for k, t in _INDEX.items()}
        parts["vectors"] = parts["vectors"].reshape(len(parts["ids"]), -1)
        parts["child"], parts["rows"] = parts["child"].reshape(-1, 2), parts["rows"].reshape(-1, 2)
        return cls(**parts, longest=row["longest"])


def _cover(points: np.ndarray, leaf: int, shrink: float) -> tuple[np.ndarray, list[list[tuple]]]:
    """The points in leaf order, and for each level its nodes: centre, radius, children's number, first and last row."""
    squares = (points**2).sum(axis=1)

    def far(members: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares[members] + squares[centre] - 2 * points[members] @ points[centre], 0))

    def split(members: np.ndarray, radius: float) -> list[tuple[np.ndarray, float]]:
        """The children: each the first point not yet covered, with those within the level's radius."""
        kids, rest = [], members
        while len(rest):
            apart = far(rest, rest[0])
            near = apart <= radius / shrink
            kids.append((rest[near], float(apart[near].max())))
            rest = rest[~near]
            if len(kids) > len(members) // 8:  # nearly every point alone: to look at all of them costs as little
                return []
        return kids

    everything = np.arange(len(points))
    current = [(everything, float(far(everything, 0).max()))]
    order, placed, levels = [], 0, []
    while current:
        following, nodes = [], []
        for members, radius in current:
            kids = split(members, radius) if len(members) > leaf and radius > 0 else []
            if not kids:
                order.append(members)
                placed += len(members)
            nodes.append((int(members[0]), radius, len(kids), placed - (0 if kids else len(members)), placed))
            following += kids
        levels.append(nodes)
        current = following
    return np.concatenate(order), levels


def tree(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, keep: int, leaf: int = LEAF, shrink: float = SHRINK) -> Tree:
    """The cover tree of the rows.

    Equal vectors are one point. Of the rows with one vector and label the ``keep`` smallest ids are enough, as all
    others come after them in every order; equal rows count once.
    """
    _, first, which = np.unique([v.tobytes() for v in vectors], return_index=True, return_inverse=True)
    order = np.lexsort((ids, labels, which))
    fresh = np.ones(len(order), dtype=bool)
    same = (which[order][1:] == which[order][:-1]) & (labels[order][1:] == labels[order][:-1])
    fresh[1:] = ~(same & (ids[order][1:] == ids[order][:-1]))
    order = order[fresh]
    head = np.ones(len(order), dtype=bool)
    head[1:] = (which[order][1:] != which[order][:-1]) | (labels[order][1:] != labels[order][:-1])
    turn = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    order = order[turn < keep]
    points = vectors[first].astype(np.float64)
    squares = (points**2).sum(axis=1)
    longest = float(squares.max())
    points = np.concatenate([points, np.sqrt(longest - squares)[:, None]], axis=1)
    placed, levels = _cover(points, leaf, shrink)
    rank = np.empty(len(placed), dtype=np.int64)
    rank[placed] = np.arange(len(placed))
    order = order[np.argsort(rank[which[order]], kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(rank[which[order]], minlength=len(placed)))])
    centre, radius, child, rows, level, begin = [], [], [], [], [0], 0
    for nodes in levels:
        begin += len(nodes)
        following = begin
        for c, r, kids, a, b in nodes:
            centre.append(at[rank[c]])
            radius.append(r)
            child.append((following, following + kids))
            rows.append((at[a], at[b]))
            following += kids
        level.append(begin)
    return Tree(
        vectors[order].astype(np.int32), ids[order], labels[order], np.array(centre, np.int64), np.array(radius),
        np.array(child, np.int64).reshape(-1, 2), np.array(rows, np.int64).reshape(-1, 2), np.array(level, np.int64), longest,
    )


class Search:
    """Asks of some anchors and the best rows found for each so far.

    An ask is an anchor's wish for the first ``k`` rows, of its label (``same``) or of others, whose product lies from
    ``low`` to ``top``.
    """

    def __init__(self, anchors: dict[str, np.ndarray], asks: dict[str, np.ndarray], k: int, same: bool):
        self.vectors, self.ids, self.labels = anchors["vectors"], anchors["ids"], anchors["labels"]
        self.squares = (self.vectors.astype(np.float64) ** 2).sum(axis=1)
        self.number, self.who, self.top = asks["number"], asks["who"], asks["top"].astype(np.float64)
        self.low = asks["low"].astype(np.float64)
        self.k, self.same = k, same
        self.found = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))  # ask, score, id
        self.products = 0  #: exact products worked out, for tests

    def _scores(self, who: np.ndarray, rows: np.ndarray) -> np.ndarray:
        width = rows.shape[1]
        mine = _fitted(self.vectors[who], width)
        most = float(np.abs(mine).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(width, 1)
        exact = np.float64 if most < 1 << 53 else np.int64
        return mine.astype(exact) @ rows.T.astype(exact)

    def _frontier(self, t: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ask, leaf, bound) of all leaves that can hold a wanted row."""
        alive = np.ones((len(self.who), 1), dtype=bool)
        out = []
        for a, b in zip(t.level[:-1], t.level[1:]):
            score = self._scores(np.arange(len(self.ids)), t.vectors[t.centre[a:b]]).astype(np.float64)
            whole = self.squares[:, None] + t.longest
            apart = np.sqrt(np.maximum(whole - 2 * score, 0))
            slack = SLACK * whole
            most = ((whole - np.maximum(apart - t.radius[a:b], 0) ** 2) / 2 + slack)[self.who]
            least = ((whole - (apart + t.radius[a:b]) ** 2) / 2 - slack)[self.who]
            alive &= (most >= self.low[:, None]) & (least <= self.top[:, None])
            kids = t.child[a:b, 1] - t.child[a:b, 0]
            ask, leaf = np.nonzero(alive & (kids == 0))
            # of leaves that reach over the window's top, first the one whose centre is nearest to it
            bound = np.minimum(most[ask, leaf], self.top[ask])
            nearness = np.abs(score[self.who[ask], leaf] - bound)
            out.append((ask, leaf + a, most[ask, leaf], bound, nearness))
            alive = np.repeat(alive, kids, axis=1)
        ask, leaf, most, bound, nearness = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((nearness, -bound, ask))
        return ask[order], leaf[order], most[order]

    def _verify(self, t: Tree, ask: np.ndarray, leaf: np.ndarray) -> None:
        order = np.argsort(leaf, kind="stable")
        ask, leaf = ask[order], leaf[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)]])
        hits = [self.found]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            mine, (first, last) = ask[a:b], t.rows[leaf[a]]
            who, back = np.unique(self.who[mine], return_inverse=True)
            score = self._scores(who, t.vectors[first:last])
            self.products += score.size
            of_label = t.labels[first:last][None, :] == self.labels[who][:, None]
            fit = (of_label == self.same) & (t.ids[first:last][None, :] != self.ids[who][:, None])
            score = score[back]
            i, j = np.nonzero(fit[back] & (score >= self.low[mine][:, None]) & (score <= self.top[mine][:, None]))
            hits.append((mine[i], score[i, j].astype(np.int64), t.ids[first:last][j]))
        ask, score, ids = (np.concatenate(c) for c in zip(*hits))
        order = np.lexsort((ids, -score, ask))
        ask, score, ids = ask[order], score[order], ids[order]
        turn = np.arange(len(ask)) - np.searchsorted(ask, ask)
        self.found = tuple(c[turn < self.k] for c in (ask, score, ids))
        last = turn == self.k - 1
        # no row below an ask's last rank is wanted any more
        self.low[ask[last]] = np.maximum(self.low[ask[last]], score[last])

    def visit(self, t: Tree) -> None:
        """Take up what the tree has for the asks, the leaves of the greatest bounds first."""
        ask, leaf, most = self._frontier(t)
        turn = np.arange(len(ask)) - np.searchsorted(ask, ask)
        begin = 0
        for end in (1, 4, 16, 64, len(ask) + 1):
            now = np.flatnonzero((turn >= begin) & (turn < end))
            now = now[most[now] >= self.low[ask[now]]]
            if len(now):
                self._verify(t, ask[now], leaf[now])
            begin = end


_TREE_SCHEMA = "chunk int, longest double, " + ", ".join(f"{k} binary" for k in _INDEX)


def index(rows: DataFrame, keep: int, chunk: int = CHUNK, cells: int = CELLS) -> DataFrame:
    """One row per chunk: its cover tree. ``rows`` has vec_id, label and vec (`scaled`) and is read more than once."""
    number = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id", "label", "vec"), "vec_id").limit(SAMPLE if number > chunk else 1).toArrow()
    top = pivots(matrix(sample.column("vec").to_pylist()), min(cells, math.ceil(number / chunk))) if number else np.zeros((0, 0))
    sent = rows.sparkSession.sparkContext.broadcast(top.astype(np.float64))  # cells vectors at most
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary()), ("cell", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = sent.value
        half = (top**2).sum(axis=1) / 2
        for batch in batches:
            # copies of a row met here count once already, so that a row repeated over and over is no large group
            fresh = list({key: i for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns)))}.values())
            batch = batch.take(pa.array(fresh, pa.int64()))
            if len(batch):
                held = _fitted(matrix(batch.column("vec").to_pylist()), top.shape[1]).astype(np.float64)
                cell = (held @ top.T - half).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], schema=schema)

    placed = stage(rows.mapInArrow(place, "vec_id long, label long, vec binary, cell int"), "negatives-cells")
    sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # cells rows at most
    begin, cuts = 0, []
    for cell in sorted(sizes):
        parts = math.ceil(sizes[cell] / chunk)
        cuts.append((cell, begin, parts))
        begin += parts
    shares = rows.sparkSession.createDataFrame(cuts, "cell int, begin int, parts int")
    turn = F.pmod(F.xxhash64("vec_id", "label", "vec"), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(shares), "cell").select((F.col("begin") + turn).alias("chunk"), "vec_id", "label", "vec")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        ids, labels = (np.asarray(table.column(c).combine_chunks()) for c in ("vec_id", "label"))
        t = tree(ids, labels, matrix(table.column("vec").to_pylist()), keep)
        columns = {"chunk": [key[0].as_py()], "longest": [t.longest]}
        columns |= {k: [getattr(t, k).astype(kind).tobytes()] for k, kind in _INDEX.items()}
        return pa.table({k: pa.array(v, pa.int32() if k == "chunk" else None) for k, v in columns.items()})

    return stage(dealt.groupBy("chunk").applyInArrow(build, _TREE_SCHEMA), "negatives-index")


def _searched(trees: DataFrame, anchors: dict, asks: dict, k: int, same: bool) -> DataFrame:
    """ask, rank (from 1), score and vec_id of the first ``k`` rows for each ask."""
    sent = trees.sparkSession.sparkContext.broadcast((anchors, asks))  # of one block
    schema = pa.schema([("ask", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, asks = sent.value
        parts = []
        for first in range(0, len(anchors["ids"]), PART):
            held = slice(first, first + PART)
            a, b = np.searchsorted(asks["who"], [first, first + PART])
            mine = {c: v[a:b] for c, v in asks.items()}
            mine["who"] = mine["who"] - first
            if b > a:
                parts.append(Search({c: v[held] for c, v in anchors.items()}, mine, k, same))
        for batch in batches:
            for row in batch.to_pylist():
                t = Tree.read(row)
                for part in parts:
                    part.visit(t)
        for part in parts:
            ask, score, ids = part.found
            yield pa.RecordBatch.from_arrays([pa.array(part.number[ask]), pa.array(score), pa.array(ids)], schema=schema)

    found = trees.drop("chunk").mapInArrow(run, "ask long, score long, vec_id long")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    rows: DataFrame, is_anchor: Column, vector: str = "embedding", scale: float = 256, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A score is the inner product of two rows' scaled integer vectors; greater ones come first, ties by smaller vec_id. An
    anchor's positives are its first rows of the same label, its negatives for a positive the first rows of another label
    whose score is from ``low`` to ``high`` per cent of the positive's.

    ``rows`` has vec_id, label and ``vector`` (other columns are not read); ``is_anchor`` may use vec_id and label. Rows with
    a null id, label, vector or component, or with a component that is not finite or, scaled, beyond 2**24, take no part.
    Equal rows count once. Rows of one id with different vectors or labels are each a row, but never each other's positive or
    negative. Shorter vectors count as filled up with zeros. An empty table, or one without anchors, gives no row.
    """
    spark = rows.sparkSession
    held = scaled(rows, vector, scale)
    chosen = stage(held.where(is_anchor).dropDuplicates(["vec_id", "label", "vec"]), "negatives-anchors")
    blocks = math.ceil(chosen.count() / block)
    path = stage_path(spark, "negatives")
    spark.createDataFrame([], _FOUND).write.parquet(path)
    trees = index(held, max(positives + 1, negatives), chunk) if blocks else None
    for number in range(blocks):
        mine = chosen.where(F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(blocks)) == number).toArrow()
        anchors = {
            "ids": np.asarray(mine.column("vec_id").combine_chunks()),
            "labels": np.asarray(mine.column("label").combine_chunks()),
            "vectors": matrix(mine.column("vec").to_pylist()),
        }
        n = len(mine)
        everything = np.full(n, np.inf)
        asks = {"number": np.arange(n), "who": np.arange(n), "low": -everything, "top": everything}
        near = _searched(trees, anchors, asks, positives, True).orderBy("ask", "rank").toArrow()
        who, score, other = (np.asarray(near.column(c).combine_chunks()) for c in ("ask", "score", "vec_id"))
        floor, top = -((-low * score) // 100), (high * score) // 100
        some = floor <= top
        who, score, other, floor, top = (c[some] for c in (who, score, other, floor, top))
        asks = {"number": np.arange(len(who)), "who": who, "low": floor, "top": top}
        pairs = pa.table(
            {"ask": asks["number"], "anchor_id": anchors["ids"][who], "positive_id": other, "positive_score": score}
        )
        found = _searched(trees, anchors, asks, negatives, False).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        named = found.join(F.broadcast(spark.createDataFrame(pairs)), "ask")  # positives of one block
        named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    return spark.read.schema(_FOUND).parquet(path)


def op12(rows: DataFrame) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", shifted.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
