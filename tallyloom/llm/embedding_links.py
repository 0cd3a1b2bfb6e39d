"""Embedding near-duplicates by dual traversal of cover trees, exact.

On unit vectors a cosine of at least c is a distance of at most t = sqrt(2 - 2c), a metric, so
covering radii prune: nothing under nodes a and b can link if d(a, b) - r(a) - r(b) > t.

Equal vectors of a label are first made one. The top of each label's tree is grown level by level
over the cluster, as far down as it takes: a cell of more than `BLOCK` vectors gets up to `FAN`
pivots of its own (farthest first over a sample of it), every vector's home is its nearest pivot's
cell, and it visits each other cell whose covering radius it comes within t of. A cell whose vectors
all lie within t / 2 of one of them is settled at once: there every pair links, so counts and a
spanning star are sums. What is left are cells of at most a block: a cover tree is built of the
cell's own vectors and one of its visitors (block by block), levels with halving radii, and the two
are traversed together; leaf pairs that survive are decided by the cosine in double precision. No
task holds more than two blocks, however hot a label or a group of near copies. A task returns the
link counts of its cell's own vectors and a spanning forest, never all pairs.

In data without structure (independent random directions) no bound prunes and vectors visit all
cells of their label, so work grows with the square of the label there; that is the nature of the
exact problem.

Vectors are scaled by a power of two, which a cosine doesn't see, so that squares of any finite components stay
within doubles.

Defined results: a vector that is null, zero or holds null or non-finite components, or has no
label, links with nothing and is counted by none; vectors of different length don't link; repeated
vec_ids are rows of their own and link like others of their vector; a row without vec_id links and is
counted like any other, and a component's id is the smallest there is, null if none of its rows has one.
"""

from __future__ import annotations

import functools
import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, table
from .components import component_labels

COSINE = 0.98
#: Vectors of a block; pivots of a cell at most, and sampled vectors for each; vectors that a task measures at once.
BLOCK, FAN, SAMPLED, RUN = 2048, 32, 8, 8192
LEAF = 8
_SLACK = 1e-6


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows with their largest component brought between 1/2 and 1; exact but for components that are nothing beside it."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class CoverTree:
    """Nested levels with halving radii over the rows of a matrix of unit vectors."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.points: list[np.ndarray | None] = []
        if len(x):
            self._build(np.arange(len(x)))

    def _node(self, points: np.ndarray, radius: float) -> int:
        self.center.append(int(points[0]))
        self.radius.append(radius)
        self.children.append(None)
        self.points.append(points)
        return len(self.center) - 1

    def _build(self, points: np.ndarray) -> None:
        radius = float(_far(self.x[points[:1]], self.x[points]).max())
        if not math.isfinite(radius):
            raise ValueError("a cover tree needs unit vectors")
        stack = [self._node(points, radius)]
        while stack:
            node = stack.pop()
            points = self.points[node]
            if len(points) <= LEAF or self.radius[node] < 1e-7:
                continue
            half, own = self.radius[node] / 2, []
            while len(points):  # the first center is the parent's: levels are nested
                d = _far(self.x[points[:1]], self.x[points])[0]
                d[0] = 0.0
                near = d <= half
                own.append(self._node(points[near], float(d[near].max())))
                points = points[~near]
            self.children[node], self.points[node] = np.array(own), None
            stack += own
        self.center_at, self.radius_at = np.array(self.center), np.array(self.radius)


def links_between(a: CoverTree, b: CoverTree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate point pairs (i of a, j of b) that covering radii can't rule out; i < j if a is b."""
    left, right = [], []
    if not a.center or not b.center:
        return np.empty(0, int), np.empty(0, int)
    stack = [(np.zeros(1, int), np.zeros(1, int))]
    limit = reach + _SLACK
    while stack:
        some, others = stack.pop()
        for k in range(0, len(some), 1024):
            own = some[k : k + 1024]
            d = _far(a.x[a.center_at[own]], b.x[b.center_at[others]])
            i, j = np.nonzero(d - a.radius_at[own][:, None] - b.radius_at[others][None, :] <= limit)
            for u, v in zip(own[i].tolist(), others[j].tolist(), strict=True):
                cu, cv = a.children[u], b.children[v]
                if cu is None and cv is None:
                    p, q = a.points[u], b.points[v]
                    left.append(np.repeat(p, len(q)))
                    right.append(np.tile(q, len(p)))
                else:
                    stack.append((np.array([u]) if cu is None else cu, np.array([v]) if cv is None else cv))
    if not left:
        return np.empty(0, int), np.empty(0, int)
    i, j = np.concatenate(left), np.concatenate(right)
    if a is b:
        keep = i < j
        i, j = i[keep], j[keep]
    return i, j


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of the pairs that join two parts not joined before."""
    up, kept = list(range(n)), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            up[x] = y
            kept.append(k)
    return kept


def block_links(reps: np.ndarray, copies: np.ndarray, x: np.ndarray, home: np.ndarray, inner: bool, cosine: float) -> dict[str, np.ndarray]:
    """Link counts (rep, added) of the home vectors of a block and a forest (x, y) of their links, with each other if `inner` and with visitors."""
    reach, norm = math.sqrt(2 - 2 * cosine), np.sqrt((x * x).sum(1))
    unit = x / norm[:, None]
    first, second = np.flatnonzero(home), np.flatnonzero(~home)
    own = CoverTree(unit[first])
    left, right = [np.empty(0, int)], [np.empty(0, int)]
    if inner:
        i, j = links_between(own, own, reach)
        left.append(first[i])
        right.append(first[j])
    if len(second):
        i, j = links_between(own, CoverTree(unit[second]), reach)
        left.append(first[i])
        right.append(second[j])
    i, j = np.concatenate(left), np.concatenate(right)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        keep[k : k + len(p)] = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= cosine
    i, j = i[keep], j[keep]
    added = np.zeros(len(reps), np.int64)
    np.add.at(added, i, copies[j])
    both = home[j]
    np.add.at(added, j[both], copies[i[both]])
    tree, some = _forest(len(reps), i, j), np.flatnonzero(added)
    return {
        "x": np.concatenate((reps[some], reps[i[tree]])),
        "y": np.concatenate((reps[some], reps[j[tree]])),
        "added": np.concatenate((added[some], np.zeros(len(tree), np.int64))),
    }


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link at all."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, scaled."""
    held = column.combine_chunks()
    return _scaled(np.asarray(held.flatten(), float).reshape(len(held), -1))


def _share(rows: DataFrame, salt: int) -> Column:
    """A number in [0, 1) for each vector, the same in every run."""
    return F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def _measured(rows: DataFrame, cells: DataFrame, block: int, fan: int) -> DataFrame:
    """Rows of open cells with their distances `d` to the cell's pivots and the nearest one, `child`.

    `cells` holds (node, n, total), the home vectors and all rows of each. A cell in whose sample all
    vectors are one has no second pivot; it is dealt by hash.
    """
    want = F.least(F.lit(fan), F.greatest(F.lit(2), F.ceil(2 * F.col("n") / block))).cast("int")
    cells = cells.withColumns({"want": want, "runs": F.ceil(F.col("total") / RUN).cast("int")})
    joined = rows.join(cells, "node")
    sample = joined.where(F.col("home") & (_share(rows, 5) < SAMPLED * F.col("want") / F.col("n"))).select("node", "want", "rep", "vector")

    def pick(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        x = _unit(_matrix(group.column("vector")))
        picked, d = [0], _far(x[:1], x)[0]
        while len(picked) < group.column("want")[0].as_py() and d.max() > 1e-7:
            picked.append(int(d.argmax()))
            d = np.minimum(d, _far(x[picked[-1:]], x)[0])
        return pa.table({"node": group.column("node")[:1], "pivots": pa.array([x[picked].ravel().tolist()], pa.list_(pa.float64())), "k": pa.array([len(picked)], pa.int32())})

    pivots = durable(sample.groupBy("node").applyInArrow(pick, "node string, pivots array<double>, k int"), "pivots")
    # an unlucky cell may have no sample: then any of its vectors will do
    lacking = joined.where("home").join(pivots, "node", "left_anti").groupBy("node").agg(F.min_by("vector", "rep").alias("v"))
    lacking = lacking.select("node", F.transform("v", lambda x: x.cast("double")).alias("pivots"), F.lit(1).alias("k"))
    dealt = pivots.union(lacking).join(cells.select("node", "runs", "want"), "node").withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    salted = joined.withColumn("run", F.floor(_share(rows, 7) * F.col("runs")).cast("int")).select("node", "run", "rep", "copies", "vector", "home")
    kind = rows.schema["vector"].dataType.simpleString()

    def measure(own: pa.Table, known: pa.Table) -> pa.Table:
        n, k = own.num_rows, known.column("k")[0].as_py() if known.num_rows else 0
        if not n or not k:
            own = own.slice(0, 0)
            d = np.empty((0, 1))
            child = np.empty(0, int)
        elif k == 1:
            d = np.tile(_far(_unit(_matrix(own.column("vector"))), _unit(_scaled(np.array([known.column("pivots")[0].as_py()], float)))), (1, known.column("want")[0].as_py()))
            child = own.column("rep").to_numpy() % d.shape[1]
        else:
            d = _far(_unit(_matrix(own.column("vector"))), np.array(known.column("pivots")[0].as_py()).reshape(k, -1))
            child = d.argmin(1)
        size = d.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * (len(d) + 1), size, dtype=np.int32)), pa.array(d.ravel()))
        kept = own.select(["node", "rep", "copies", "vector", "home"])
        return kept.append_column("child", pa.array(child.astype(np.int32))).append_column("d", lists)

    measured = salted.groupBy("node", "run").cogroup(dealt.groupBy("node", "run")).applyInArrow(measure, f"node string, rep long, copies long, vector {kind}, home boolean, child int, d array<double>")
    return durable(measured, "measured")


def _grown(distinct: DataFrame, reach: float, block: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Leaf rows (node, rep, copies, vector, home, dense) and the links that dense cells give."""
    node = F.concat_ws(":", F.col("label").cast("string"), F.col("dim").cast("string"))
    rows = durable(distinct.select(node.alias("node"), "rep", "copies", "vector", F.lit(True).alias("home")), "rows")
    leaves, settled = [], []
    columns = ["node", "rep", "copies", "vector", "home"]
    while True:
        size = rows.groupBy("node").agg(F.count_if("home").alias("n"), F.count(F.lit(1)).alias("total"))
        cells = durable(size.where(F.col("n") > block), "cells")
        if cells.isEmpty():
            leaves.append(rows.withColumn("dense", F.lit(False)))
            break
        leaves.append(rows.join(cells.select("node"), "node", "left_anti").withColumn("dense", F.lit(False)))
        measured = _measured(rows, cells, block, fan)
        radius = measured.where("home").groupBy("node", "child").agg(F.max(F.col("d")[F.col("child")]).alias("r"), F.max(F.col("d")[0]).alias("far"))
        radius = radius.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("child", "r"))).alias("radii"), F.max("far").alias("far"))
        radius = durable(radius.withColumn("dense", F.col("far") + _SLACK <= reach / 2), "radii")
        dense = measured.join(radius.where("dense").select("node"), "node", "left_semi")
        leaves.append(dense.select(*columns, F.lit(True).alias("dense")))
        every = dense.where("home").groupBy("node").agg(F.sum("copies").alias("all"), F.min("rep").alias("first"))
        star = dense.where("home").join(every, "node")
        settled.append(star.select(F.col("rep").alias("x"), F.col("rep").alias("y"), (F.col("all") - F.col("copies")).alias("added")).where("added > 0"))
        settled.append(star.where("rep <> first").select(F.col("first").alias("x"), F.col("rep").alias("y"), F.lit(0).cast("long").alias("added")))
        open_rows = measured.join(radius.where("NOT dense").select("node", "radii"), "node")
        near = F.filter(F.map_entries("radii"), lambda e: (F.col("d")[e["key"]] <= e["value"] + reach + _SLACK) | (F.col("home") & (e["key"] == F.col("child"))))
        each = open_rows.select("node", "rep", "copies", "vector", "home", "child", F.explode(F.transform(near, lambda e: e["key"])).alias("to"))
        rows = each.select(F.concat_ws("/", "node", F.col("to").cast("string")).alias("node"), "rep", "copies", "vector", (F.col("home") & (F.col("to") == F.col("child"))).alias("home"))
        rows = durable(rows, "rows")
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.unionByName(more)
    return leaf, functools.reduce(DataFrame.unionByName, settled) if settled else None


def link(distinct: DataFrame, cosine: float = COSINE, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(x, y, added) rows from distinct (label, dim, rep, copies, vector): counts have x = y, forest links not."""
    leaf, settled = _grown(distinct, math.sqrt(2 - 2 * cosine), block, fan)
    size = leaf.groupBy("node", "dense").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors"))
    some = (F.col("homes") > 0) & ((F.col("visitors") > 0) | (~F.col("dense") & (F.col("homes") > 1)))
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    size = durable(size.where(some).select("node", parts("homes").alias("hs"), parts("visitors").alias("vs")), "leaves")
    at = leaf.join(size, "node")
    piece = lambda n: F.array(F.floor(_share(leaf, 11) * F.col(n)).cast("int"))
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = at.withColumn("h", F.explode(F.when(F.col("home"), piece("hs")).otherwise(all_of("hs"))))
    at = at.withColumn("v", F.explode(F.when(F.col("home"), all_of("vs")).otherwise(piece("vs"))))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")  # the same trees in each run
        home = np.array(group.column("home").to_pylist(), bool)
        inner = group.column("v")[0].as_py() == 0 and not group.column("dense")[0].as_py()
        return pa.table(block_links(group.column("rep").to_numpy(), group.column("copies").to_numpy(), _matrix(group.column("vector")), home, inner, cosine))

    found = at.select("node", "h", "v", "rep", "copies", "vector", "home", "dense").groupBy("node", "h", "v").applyInArrow(compare, "x long, y long, added long")
    return found if settled is None else found.unionByName(settled)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(vec_id, n_links, component_id) of rows (vec_id, embedding, label)."""
    at = vectors.select("vec_id", "label", F.col("embedding").alias("vector")).withColumn("usable", usable(F.col("vector"), F.col("label")))
    at = at.withColumns({"dim": F.size("vector"), "k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector")})
    fit = at.where("usable")
    keys = ["label", "dim", "k1", "k2"]
    least = F.min("vec_id").alias("first")
    distinct = fit.groupBy(*keys).agg(least, F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector"))
    distinct = durable(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors")  # written, so the numbers stay
    found = durable(link(distinct.select("label", "dim", "rep", "copies", "vector"), cosine, block, fan), "links")
    added = found.where("added > 0").groupBy(F.col("x").alias("rep")).agg(F.sum("added").alias("added"))
    moved = component_labels(found.where("x <> y"), "x", "y").withColumnsRenamed({"node": "rep", "label": "part"})
    moved = durable(moved.join(distinct.select("rep", "first"), "rep"), "moved")
    named = moved.join(moved.groupBy("part").agg(F.min("first").alias("least")), "part").select("rep", "least")
    known = distinct.select(*keys, "rep", "copies", "first").join(added, "rep", "left").join(named, "rep", "left")
    n_links = (F.coalesce("added", F.lit(0)) + F.col("copies") - 1).cast("long")
    known = known.select(*keys, n_links.alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    linked = fit.select("vec_id", *keys).join(known, keys).select("vec_id", "n_links", "component_id")
    single = at.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(single)


def op5_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
