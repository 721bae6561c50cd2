"""Connected components of an edge table, and the classes of linked ids: alternating large-star and small-star rounds.

A round takes each vertex's least neighbour by an aggregation with map-side minima and joins it back, so no vertex's neighbours are ever
gathered in one row or task (a hot vertex's rows are split by the adaptive skew join); each round is cut by a checkpoint.  Rounds go on
until the edges stay as they are; their number grows with the logarithm of the longest path.

Up to DRIVER_EDGES edges (16 MB), which are counted first, the driver does the same in memory, as a round costs more than that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


#: Edges up to which components are found on the driver.
DRIVER_EDGES = 1_000_000


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the least id of each one's component) of edges in memory."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def _least(e: DataFrame) -> DataFrame:
    """(u, v, m): the edges with the least v of their u."""
    return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each component, for all ids in the first two columns of edges.

    Nulls are dropped; repeated edges and loops do no harm (an id with a loop only is its own component);
    an empty table gives an empty table.
    """
    a, b = edges.columns[:2]
    given = checkpoint(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna().select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if given.count() <= DRIVER_EDGES:
        t = given.toArrow()
        found, least = least_of(t["u"].to_numpy(), t["v"].to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"id": pa.array(found, pa.int64()), "component": pa.array(least, pa.int64())}))
    ids, e = given.where("u = v").select("u"), given.where("u <> v")
    last = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = checkpoint(small.select("x.u", "x.v").where("u <> v").distinct())
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    loops = ids.select(F.col("u").alias("id"), F.col("u").alias("component"))
    return stars.union(roots).union(loops).groupBy("id").agg(F.min("component").alias("component"))


def spread(links: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray, copies: np.ndarray) -> None:
    """Adds the links of the pairs (i, j) of sets to links, and makes root the least of what they lead to."""
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    while (root[i] != root[j]).any():
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)


def classes(members: DataFrame, found: DataFrame, alone: bool) -> DataFrame:
    """id, class_id, n_links of each id (without a link only if alone).

    members: id, rep, s, copies: the sets (rep, s) of each id, rep being the least id of a set and copies their number; found: rep, s,
    root, links: links of the set to ids of others, and an id that these lead to, each in any number of rows."""
    members, found = checkpoint(members), checkpoint(found)
    # an id with several sets links them; other copies need not take part in the search for components
    twice = members.groupBy("id").count().where("count > 1").select("id")
    edges = found.select("rep", "root").union(members.join(twice, "id").select("id", "rep"))
    least = components(edges).toDF("rep", "class_id")
    links = found.groupBy("rep", "s").agg(F.sum("links").alias("links"))
    out = members.join(links, ["rep", "s"], "left")
    if not alone:
        out = out.where("copies > 1 OR links IS NOT NULL")
    out = out.join(least, "rep", "left")
    return out.groupBy("id").agg(F.min(F.coalesce("class_id", "rep")).alias("class_id"), F.sum(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
