"""Exact top-k by inner product: ball trees per shard, branch and bound.

Vectors are floored to integers after scaling. All rows are dealt into shards of about
``shard_rows``; each shard builds a ball tree (split on the widest direction, leaves of
``leaf_rows``, a ball for every inner node). The stated queries form blocks, and each
block meets every shard.

A search begins at the root and goes down; each query takes the child with the larger
upper bound first, centre . q + radius * |q|, and comes back for the other only if that
can still reach its k-th score (equal scores are looked at, as ties go to the smaller id).
Queries of a block that go the same way are one matrix product. The k-th score is shared:
all queries search one pilot shard first, and what they find there is the bar for every
other task; within a task a query's best so far goes on from shard to shard. Each task
returns k rows per query and run of shards, and a final ranking per query merges them.

Scores are exact: float64 where every sum stays below 2**53, Python integers beyond,
held to the range of a long. Vectors that are null, empty, or hold a null or non-finite
component take no part; vectors of different lengths are never compared. Repeated rows
are candidates each; a query's own row is every row of its vec_id; of repeated query
ids the smallest vector asks. Fewer candidates than k give as many rows; an empty table
gives none; further columns, whatever their names, are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SCALE = 256
SAFE = float(1 << 53)
OUT = "query_id long, vec_id long, score long"


class Tree:
    """A ball tree over the rows of v. Node 0 is the root; a node's rows are
    order[lo:hi]; left is -1 for a leaf and the right child comes behind the left one."""

    def __init__(self, v: np.ndarray, leaf: int):
        self.order = np.arange(len(v))
        self.lo, self.hi, self.left, self.centre, self.radius = [], [], [], [], []
        todo = [self._node(v, 0, len(v))]
        while todo:
            node, far = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            dist = (far * far).sum(axis=1)
            if hi - lo <= leaf or dist.max() == 0:
                continue
            a = far[dist.argmax()]
            b = far[((far - a) ** 2).sum(axis=1).argmax()]
            self.order[lo:hi] = self.order[lo:hi][np.argsort(far @ (a - b), kind="stable")]
            half = (lo + hi) // 2
            children = [self._node(v, lo, half), self._node(v, half, hi)]
            self.left[node] = children[0][0]
            todo += children
        self.v, self.centre = v[self.order].astype(np.float64), np.array(self.centre)

    def _node(self, v: np.ndarray, lo: int, hi: int) -> tuple[int, np.ndarray]:
        x = v[self.order[lo:hi]].astype(np.float64)
        centre = x.mean(axis=0)
        far = x - centre
        # rounding must not make the ball too small
        radius = float(np.sqrt((far * far).sum(axis=1).max())) * (1 + 1e-9) + 1e-6
        for name, value in (("lo", lo), ("hi", hi), ("left", -1), ("centre", centre), ("radius", radius)):
            getattr(self, name).append(value)
        return len(self.lo) - 1, far


class Best:
    """The k best (score, id) of each query of a block, larger scores and then smaller
    ids first."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: (len(at), len(ids)), -inf where a pair doesn't count."""
        s = np.concatenate([self.score[at], score], axis=1)
        i = np.concatenate([self.ids[at], np.broadcast_to(ids, score.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[at] = np.take_along_axis(s, order, 1)
        self.ids[at] = np.take_along_axis(i, order, 1)


def search(q: np.ndarray, q_ids: np.ndarray, v_ids: np.ndarray, tree: Tree, best: Best, bar: np.ndarray) -> int:
    """Updates best; bar: for each query a score that its k-th is known to reach. Returns
    the number of (query, row) pairs looked at."""
    q = q.astype(np.float64)
    norm = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-12)
    seen = 0

    def bound(node: int, at: np.ndarray) -> np.ndarray:
        near = q[at] @ tree.centre[node]
        return near + norm[at] * tree.radius[node] + np.abs(near) * 1e-9 + 1e-6

    def visit(node: int, at: np.ndarray, most: np.ndarray) -> None:
        nonlocal seen
        at = at[most >= np.maximum(best.score[at, -1], bar[at])]
        if not len(at):
            return
        left = tree.left[node]
        if left < 0:
            lo, hi = tree.lo[node], tree.hi[node]
            ids = v_ids[tree.order[lo:hi]]
            score = q[at] @ tree.v[lo:hi].T
            score[q_ids[at][:, None] == ids[None, :]] = -np.inf
            seen += len(at) * (hi - lo)
            hit = score.max(axis=1) >= np.maximum(best.score[at, -1], bar[at])
            if hit.any():
                best.add(at[hit], score[hit], ids)
            return
        x, y = bound(left, at), bound(left + 1, at)
        first = x >= y
        for child, most, these in ((left, x, first), (left + 1, y, ~first), (left + 1, y, first), (left, x, ~first)):
            visit(child, at[these], most[these])

    every = np.arange(len(q))
    visit(0, every, bound(0, every))
    return seen


def _slow(q, q_ids, v, v_ids, k):
    """The same by Python integers, for components beyond exact float64."""
    top = (1 << 63) - 1
    for a, i in zip(q.tolist(), q_ids.tolist(), strict=True):
        got = sorted(
            ((-max(-top - 1, min(top, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))), j) for b, j in zip(v.tolist(), v_ids.tolist(), strict=True) if j != i)
        )[:k]
        for s, j in got:
            yield i, j, -s


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>): the rows that take part, floored after scaling."""
    x = F.col(vec_col).cast("array<double>")
    good = F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    narrow = df.where(F.col(id_col).isNotNull()).where(good)
    # doubles from 2**53 on are whole, and may be beyond a long
    v = F.transform(x, lambda c: F.when(F.abs(c * SCALE) < SAFE, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    return narrow.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding",
          shard_rows: int = 4096, block_rows: int = 1024, leaf_rows: int = 256, run_shards: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row with an id that
    ``every`` divides."""
    rows = usable(df, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"))
    total = sizes.agg(F.sum("n"), F.sum("q")).first()
    n, n_q = int(total[0] or 0), int(total[1] or 0)
    shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-n_q // block_rows))
    runs = max(1, -(-shards // run_shards))
    dealt = rows.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))

    def bundle(side, with_bar=False):
        names = ["dim", side, "ids", "vecs"] + ["bars"] * with_bar

        def run(batches):
            held: dict[tuple, list] = {}
            for b in batches:
                for key, group in _by_key(b):
                    held.setdefault(key, []).append(group)
            for key, parts in held.items():
                columns = [np.concatenate(c).tobytes() for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in key), *(pa.array([x]) for x in columns)], names)

        return run

    vectors = dealt.repartition(max(1, min(shards, 20_000)), "shard").mapInArrow(bundle("shard"), "dim int, shard int, ids binary, vecs binary")
    asks = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asks = asks.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"))
    def searched(met: DataFrame) -> DataFrame:
        def run(batches):
            state: dict[tuple, tuple] = {}  # of the blocks at hand: their best so far in this task
            done = []
            tree_key, tree = None, None
            for b in batches:
                for i in range(b.num_rows):
                    dim, shard, block = (b.column(c)[i].as_py() for c in range(3))
                    v_ids, q_ids, bar = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in ((3, "<i8"), (5, "<i8"), (7, "<f8")))
                    v, q = (np.frombuffer(b.column(c)[i].as_py(), "<f8").reshape(-1, dim) for c in (4, 6))
                    if np.abs(v).max() * np.abs(q).max() * dim >= SAFE:
                        done += list(_slow(q, q_ids, v, v_ids, k))
                        continue
                    if tree_key != (dim, shard):
                        tree_key, tree = (dim, shard), Tree(v, leaf_rows)
                    if (dim, block) not in state:
                        state[dim, block] = (q_ids, Best(len(q_ids), k))
                    search(q, q_ids, v_ids, tree, state[dim, block][1], bar)
            for q_ids, best in state.values():
                at, slot = np.nonzero(np.isfinite(best.score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[at]), pa.array(best.ids[at, slot]), pa.array(best.score[at, slot].astype(np.int64))], ["query_id", "vec_id", "score"]
                )
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], ["query_id", "vec_id", "score"])

        return met.select("dim", "shard", "block", "ids", "vecs", "q_ids", "q_vecs", "bars").mapInArrow(run, OUT)

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def in_blocks(asks: DataFrame) -> DataFrame:
        made = asks.repartition(max(1, min(n_blocks, 20_000)), "block").mapInArrow(bundle("block", True), "dim int, block int, ids binary, vecs binary, bars binary")
        return durable(made).select("dim", "block", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "bars")

    least = F.lit(-float("inf"))
    if shards > 1:
        pilot = vectors.where("shard = 0").join(in_blocks(asks.withColumn("bar", least)), "dim")
        kth = ranked(searched(pilot)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
        blocks = in_blocks(asks.join(kth, "vec_id", "left").withColumn("bar", F.coalesce("bar", least)))
    else:
        blocks = in_blocks(asks.withColumn("bar", least))
    # each block meets each run of shards: a block is copied once per run, not per vector
    spread = blocks.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    met = vectors.withColumn("run", F.pmod(F.col("shard"), F.lit(runs))).join(spread, ["dim", "run"])
    return ranked(searched(met)).select("query_id", "rank", "vec_id", "score")


def _by_key(b):
    """Groups of a batch (vec_id, v, dim, group, further doubles) as ((dim, group), (ids,
    vectors, further))."""
    ids, dim, group = (b.column(i).to_numpy() for i in (0, 2, 3))
    more = [b.column(i).to_numpy() for i in range(4, b.num_columns)]
    flat, off = b.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(dim)])
    for key in sorted(set(zip(dim.tolist(), group.tolist(), strict=True))):
        at = np.flatnonzero((dim == key[0]) & (group == key[1]))
        take = (off[at][:, None] + np.arange(key[0])[None, :]).ravel()
        yield key, (ids[at].astype("<i8"), flat[take].reshape(len(at), key[0]).astype("<f8"), *(x[at].astype("<f8") for x in more))
