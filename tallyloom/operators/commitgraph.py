"""Reachability in commit graphs, by blocks in topological order.

Commits of a work are numbered from its newest on, in an order in which children come before parents (a
generation number, or the order a repository lists them in), and cut into blocks of `BLOCK` commits.

`reached` settles all blocks at once: each block tells how far its entries (commits that another block's
lead to, and starts) are from what leaves it; the graph of entries alone, a few rows for each block, is
solved the same way, and then each block is settled from its entries. Blocks with more entries than
`WIDEST`, and graphs that this does not make smaller, are walked by `rounds`.

Each of the `rounds` settles one block of every work: what has been carried into it, the block's own
edges, and nothing else; distances are final in one pass as all children lie before. What leaves the
block is carried on, one row for each commit that is met first. So rounds are the blocks of the longest
history, not its depth, each commit is expanded once, and a merge-rich history costs its edges.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.cuts import durable
from tallyloom.operators.running import running_sum

#: Commits of a work that one task settles.
BLOCK = 1 << 16
#: Entries of a block whose distances to what leaves it are found together; a block with more stays as it is.
WIDEST = 64
#: Rounds that are walked as they are.
FEW = 4
#: The distance of what is not reached.
_FAR = 1 << 62


def blocked(commits: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    """(work_id, id, place, block) of distinct commits (work_id, id, order), the largest order first; a hot work spans many tasks."""
    nodes = commits.groupBy("work_id", "id").agg(F.max(order).alias("order")).withColumn("one", F.lit(1))
    placed = running_sum(nodes, "work_id", [F.desc("order"), F.desc("id")], "one", "place")
    return durable(placed.select("work_id", "id", "place", F.floor(F.col("place") / block).cast("int").alias("block")), "blocks")


def _settled(carried: pa.Table, edges: pa.Table) -> pa.Table:
    """Of one block of one work: its reached commits and what leaves it, with least depths. Edges come by the child's place."""
    depth: dict = {}
    for i, d in zip(carried.column("id").to_pylist(), carried.column("depth").to_pylist()):
        depth[i] = min(d, depth.get(i, d))
    away: dict = {}
    edges = edges.sort_by("place")
    for child, parent, block, at, weight in zip(*(edges.column(c).to_pylist() for c in ("id", "parent_id", "block", "parent_block", "weight"))):
        d = depth.get(child)
        if d is None:
            continue
        d += weight
        if at == block:
            depth[parent] = min(d, depth.get(parent, d))
        else:
            away[parent] = (min(d, away.get(parent, (d, at))[0]), at)
    work = (carried if carried.num_rows else edges).column("work_id")[0].as_py() if carried.num_rows or edges.num_rows else None
    rows = [(work, i, None, d) for i, d in depth.items()] + [(work, i, at, d) for i, (d, at) in away.items()]
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = {c: carried.schema.field(c).type for c in ("work_id", "id")}
    return pa.table([pa.array(columns[0], kinds["work_id"]), pa.array(columns[1], kinds["id"]), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], ["work_id", "id", "block", "depth"])


def _from_entries(entries: pa.Table, edges: pa.Table) -> pa.Table:
    """Of one block of one work: least distances from its entries to what leaves it, as edges between places; the block's own edges where those are fewer."""
    edges = edges.sort_by("place")
    raw = edges.select(["work_id", "place", "parent_place", "weight"])
    own = np.unique(entries.column("place").to_numpy())
    if not len(own) or not edges.num_rows:
        return raw.slice(0, 0)
    away = pc.not_equal(edges.column("block"), edges.column("parent_block"))
    exits = np.unique(edges.filter(away).column("parent_place").to_numpy())
    if len(own) > WIDEST or len(own) * len(exits) > edges.num_rows:
        return raw
    children, parents = edges.column("place").to_numpy(), edges.column("parent_place").to_numpy()
    known = np.unique(np.concatenate([own, children, parents]))
    far = np.full((len(known), len(own)), _FAR)
    far[np.searchsorted(known, own), np.arange(len(own))] = 0
    for c, p, w in zip(np.searchsorted(known, children).tolist(), np.searchsorted(known, parents).tolist(), edges.column("weight").to_pylist()):
        np.minimum(far[p], far[c] + w, out=far[p])  # what leaves is never a child here
    out, start = np.nonzero((met := far[np.searchsorted(known, exits)]) < _FAR)
    work = pa.array([edges.column("work_id")[0].as_py()] * len(out), raw.schema.field("work_id").type)
    return pa.Table.from_arrays([work, pa.array(own[start], pa.int64()), pa.array(exits[out], pa.int64()), pa.array(met[out, start], pa.int64())], names=raw.column_names)


def _laid(commits: DataFrame, order: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The blocks' commits, and the edges between them with both ends' places and blocks; a `weight` of 1 where there is none."""
    nodes = blocked(commits, order, block)
    to = nodes.select("work_id", F.col("id").alias("parent_id"), F.col("block").alias("parent_block"), F.col("place").alias("parent_place"))
    edges = commits if "weight" in commits.columns else commits.withColumn("weight", F.lit(1).cast("long"))
    edges = edges.where("parent_id IS NOT NULL").select("work_id", "id", "parent_id", "weight").distinct().join(nodes, ["work_id", "id"]).join(to, ["work_id", "parent_id"])
    edges = durable(edges.repartition("block"), "edges")
    if wrong := edges.where("parent_place <= place").limit(1).collect():
        raise ValueError(f"{order} puts parent {wrong[0]['parent_id']} of {wrong[0]['work_id']} before its child {wrong[0]['id']}")
    return nodes, edges


def _begun(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The starts that are commits, in their blocks."""
    found = starts.select("work_id", "id").distinct().join(nodes, ["work_id", "id"])
    return durable(found.select("work_id", "id", "place", "block", F.lit(0).cast("long").alias("depth")), "starts")


def _form(nodes: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    return f"work_id {kinds['work_id']}, id {kinds['id']}, block int, depth long"


def _own(edges: DataFrame) -> DataFrame:
    return edges.select("work_id", "id", "parent_id", "place", "block", "parent_block", "weight")


def _walked(edges: DataFrame, begun: DataFrame, form: str) -> Iterator[DataFrame]:
    """For each round what it settles for good."""
    carried = begun.select("work_id", "id", "block", "depth")
    at = carried.agg(F.min("block")).first()[0]
    while at is not None:
        now, later = carried.where(F.col("block") == at), carried.where(F.col("block") > at)
        own = _own(edges.where(F.col("block") == at))
        found = durable(now.groupBy("work_id").cogroup(own.groupBy("work_id")).applyInArrow(_settled, form), "settled")
        yield found.where("block IS NULL").select("work_id", "id", "depth")
        met = later.unionByName(found.where("block IS NOT NULL")).groupBy("work_id", "id", "block").agg(F.min("depth").alias("depth"))
        carried = durable(met.select("work_id", "id", "block", "depth"), "carried")
        at = carried.agg(F.min("block")).first()[0]


def rounds(commits: DataFrame, starts: DataFrame, order: str = "id", block: int = BLOCK) -> Iterator[DataFrame]:
    """For each round the newly reached (work_id, id, depth), settled for good.

    `commits` has a row (work_id, id, parent_id, order) for each parent of a commit, or one without a
    parent; `starts` has (work_id, id). Starts that are no commits and parents that are missing (shallow histories) are
    passed over. A parent that comes before its child is an error: no order of a graph has that.
    """
    nodes, edges = _laid(commits, order, block)
    yield from _walked(edges, _begun(starts, nodes), _form(nodes))


def _all_rounds(edges: DataFrame, begun: DataFrame, form: str) -> DataFrame:
    every = list(_walked(edges, begun, form))
    return functools.reduce(DataFrame.unionByName, every) if every else begun.select("work_id", "id", "depth")


def reached(commits: DataFrame, starts: DataFrame, order: str = "id", block: int = BLOCK) -> DataFrame:
    """(work_id, id, depth): all commits that the starts of each work reach, with their least distance.

    Takes what `rounds` takes, and an edge's length if there is a `weight`. The number of steps grows with
    the logarithm of the longest history.
    """
    nodes, edges = _laid(commits, order, block)
    begun, form = _begun(starts, nodes), _form(nodes)
    last, n = edges.agg(F.max("block"), F.count(F.lit(1))).first()
    if last is None or last < FEW:
        return _all_rounds(edges, begun, form)
    led = edges.where("block <> parent_block").select("work_id", F.col("parent_block").alias("block"), F.col("parent_place").alias("place"), F.col("parent_id").alias("id"))
    entries = durable(led.unionByName(begun.select("work_id", "block", "place", "id")).distinct(), "entries")
    of = edges.select("work_id", "place", "block", "parent_place", "parent_block", "weight")
    kind = nodes.schema["work_id"].dataType.simpleString()
    short = entries.select("work_id", "block", "place").groupBy("work_id", "block").cogroup(of.groupBy("work_id", "block"))
    short = durable(short.applyInArrow(_from_entries, f"work_id {kind}, place long, parent_place long, weight long"), "short")
    if 2 * short.count() > n:
        return _all_rounds(edges, begun, form)
    # the places of this graph are the commits of the next, in the same order
    own = short.select("work_id", F.col("place").alias("id"), F.col("parent_place").alias("parent_id"), "weight")
    ends = own.select("work_id", F.col("parent_id").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit(1).cast("long").alias("weight"))
    known = reached(own.unionByName(ends).withColumn("order", -F.col("id")), begun.select("work_id", F.col("place").alias("id")), "order", block)
    met = entries.join(known.select("work_id", F.col("id").alias("place"), "depth"), ["work_id", "place"]).select("work_id", "id", "block", "depth")
    met = met.unionByName(begun.select("work_id", "id", "block", "depth")).groupBy("work_id", "id", "block").agg(F.min("depth").alias("depth"))
    found = met.select("work_id", "id", "block", "depth").groupBy("work_id", "block").cogroup(_own(edges).groupBy("work_id", "block")).applyInArrow(_settled, form)
    return durable(found.where("block IS NULL").select("work_id", "id", "depth"), "reached")


def reached_objects(commits: DataFrame, starts: DataFrame, objects: DataFrame, wanted: DataFrame, order: str = "id", block: int = BLOCK) -> DataFrame:
    """(work_id, object_id): the wanted objects (object_id) in commits (work_id, id, object_id of `objects`) that the starts reach.

    Objects that no one asks for are left out before anything is walked; the walk stops as soon as every
    work has found all that it holds of the wanted ones anywhere.
    """
    held = durable(objects.join(wanted.select("object_id").distinct(), "object_id", "left_semi").select("work_id", "id", "object_id"), "wanted")
    every = held.select("work_id", "object_id").distinct().join(starts.select("work_id").distinct(), "work_id", "left_semi").count()
    found, out = 0, None
    for some in rounds(commits, starts, order, block) if every else ():
        new = some.join(held, ["work_id", "id"]).select("work_id", "object_id").distinct()
        out = durable(new if out is None else out.unionByName(new).distinct(), "found")
        found = out.count()
        if found == every:
            break
    return held.select("work_id", "object_id").where("false") if out is None else out
