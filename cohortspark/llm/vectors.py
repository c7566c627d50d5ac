"""Embedding near-dedup: an exact metric range join.

On unit vectors, cosine >= t is a distance of at most r = sqrt(2 - 2t). Pivot vectors cut the space into cells
(a vector is at home in the cell of its nearest pivot). By the triangle inequality a vector within r of another
one lies at most r beyond the border that separates their pivots' cells, so it is copied as a guest to the
cells whose border it is that near to. Then every vector meets all its partners in its home cell, and cells are
joined independently, large ones in tiles of bounded size. Equal vectors are one class with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, unit
from .components import components

CELL, TILE, MAX_PIVOTS = 2048, 1024, 256


def _units(column: pa.Array) -> list[np.ndarray]:
    data = [np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)]
    data = [v / np.abs(v).max() for v in data]
    return [v / np.sqrt(v @ v) for v in data]


def _placer(pivots: np.ndarray, radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
        for batch in batches:
            vectors = _units(batch.column("v"))
            for at in range(0, len(vectors), 512):
                part = vectors[at : at + 512]
                x = np.zeros((len(part), pivots.shape[1]))
                for i, v in enumerate(part):
                    x[i, : len(v)] = v
                d2 = np.maximum(0, 2 - 2 * x @ pivots.T)
                home = d2.argmin(1)
                beyond = d2 - d2[np.arange(len(part)), home][:, None] <= 2 * (radius + 1e-9) * apart[home] + 1e-9
                beyond[np.arange(len(part)), home] = True
                row, cell = np.nonzero(beyond)
                pick = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").take(pick), pa.array([len(part[i]) for i in row], pa.int32()), pa.array(cell, pa.int32()), pa.array(cell == home[row]), batch.column("rep").take(pick), batch.column("n").take(pick), pa.array([part[i].tobytes() for i in row], pa.binary())],
                    ["label", "dims", "cell", "home", "rep", "n", "u"],
                )

    return run


def _tile(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        left = group.column("left").to_numpy()
        rep, n = group.column("rep").to_numpy(), group.column("n").to_numpy()
        u = np.stack([np.frombuffer(x, np.float64) for x in group.column("u").to_pylist()])
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        near = (u[a] @ u[b].T >= threshold) & (rep[a][:, None] != rep[b][None])
        links = near @ n[b].astype(float)
        if not near.any():
            none = pa.array([], pa.int64())
            return pa.Table.from_arrays([none, none, none], ["rep", "links", "root"])
        # the tile's components, so that it returns a line for each vector and none for each pair
        ids = np.unique(rep)
        ia, ib = np.searchsorted(ids, rep[a]), np.searchsorted(ids, rep[b])
        label, far = np.arange(len(ids)), len(ids)
        while True:
            before = label.copy()
            np.minimum.at(label, ia, np.where(near, label[ib][None], far).min(1))
            np.minimum.at(label, ib, np.where(near, label[ia][:, None], far).min(0))
            label = label[label]
            if (label == before).all():
                break
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, ia, links.astype(np.int64))
        keep = (count > 0) | (label != np.arange(len(ids)))
        return pa.Table.from_arrays([pa.array(ids[keep]), pa.array(count[keep]), pa.array(ids[label[keep]])], ["rep", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors; ids are integers.

    Only vectors of equal, non-null label and equal length are compared. Null, empty and zero vectors, and those with
    null or non-finite parts, link with nothing. n_links counts the other rows at or above the threshold."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    classes = saved(usable.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v")))
    facts = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    if not facts["n"]:
        return rows.select(F.col("id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    wanted = int(min(MAX_PIVOTS, max(2, -(-facts["n"] // CELL))))
    pivots = np.zeros((0, facts["d"]))
    for r in classes.orderBy(unit(F.col("rep"), F.col("h1")), "h1").limit(wanted).collect():  # at most MAX_PIVOTS vectors
        v = np.array(r["v"]) / np.abs(r["v"]).max()
        pivots = np.vstack([pivots, np.pad(v / np.sqrt(v @ v), (0, facts["d"] - len(v)))])
    placed = classes.select("label", "rep", "n", "v").mapInArrow(_placer(pivots, float(np.sqrt(2 - 2 * threshold))), "label string, dims int, cell int, home boolean, rep long, n long, u binary")
    placed = saved(placed)
    key = ["label", "dims", "cell"]
    blocks = placed.groupBy(key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    sized = placed.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lefts = sized.where("home").select(*key, F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("left"), "rep", "n", "u")
    rights = sized.select(*key, F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"), "rep", "n", "u")
    found = saved(lefts.unionByName(rights).groupBy(*key, "i", "j").applyInArrow(_tile(threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_class = classes.select("label", "h1", "h2", "rep", "n").join(links, "rep", "left").join(roots, F.col("rep") == F.col("id"), "left").select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    member = usable.select("id", "label", "h1", "h2").join(by_class, ["label", "h1", "h2"]).select("id", "n_links", "component_id")
    rest = rows.where(~(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return member.unionByName(rest).select(F.col("id").alias(vec_id), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op7_vectors(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x)
SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.x = e.vec_id) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = e.vec_id"""
