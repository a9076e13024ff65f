"""Similarity join of vectors by the epsilon grid order (Boehm et al., 2001).

Unit vectors are rotated to principal dimensions; the leading ones are cut into cells as wide as the Euclidean distance
that the cosine threshold stands for. Vectors are sorted by label and cells, and cut into blocks of neighbours. Pairs of
blocks whose boxes lie within that distance are joined by recursion: an interval pair that is provably distant is
skipped, a small one is compared exactly in double precision, any other is halved. Pairs of blocks go to tasks by tiles, so
that few copies of a block are sent. Equal vectors are one entry with a count, pairs never leave a task: it sends the links of each vector as a number, and a spanning forest for the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gritmill.llm.common import Scratch
from gritmill.llm.components import connected_components

BLOCK, LEAF, DIMS, SAMPLE = 1024, 128, 8, 4096
#: Neighbouring blocks of a tile's side: 2 * GROUP * BLOCK vectors are in a task's memory at once.
GROUP = 8
_SLACK = 1e-6


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(bases: dict[int, np.ndarray], eps: float):
    names = [f"c{i}" for i in range(DIMS)]

    def run(batches):
        for b in batches:
            vectors = b.column("embedding").to_pylist()
            cells = np.zeros((len(vectors), DIMS), np.int32)
            packed = []
            for i, v in enumerate(vectors):
                x = np.array(v, np.float32)
                packed.append(x.tobytes())
                base = bases.get(len(x))
                if base is not None:
                    y = (x.astype(np.float64) / np.linalg.norm(x.astype(np.float64))) @ base
                    cells[i, : len(y)] = np.floor(y / eps)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("id"), b.column("n"), pa.array([len(v) for v in vectors], pa.int32()), pa.array(packed, pa.binary()), *(pa.array(cells[:, i]) for i in range(DIMS))], names=["label", "id", "n", "dim", "vec", *names])

    return run


_BLOCK = "bid long, label long, dim int, lo int, hi int, low array<double>, high array<double>, ids array<bigint>, counts array<bigint>, vecs binary"


def _blocks(bases: dict[int, np.ndarray]):
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def run(batches):
        part, n, held, key = TaskContext.get().partitionId() << 32, 0, [], None

        def flush():
            vecs = b"".join(r["vec"] for r in held)
            dim = key[1]
            unit = _unit(np.frombuffer(vecs, np.float32).reshape(len(held), dim))
            y = unit @ bases[dim] if dim in bases else np.zeros((len(held), 1))
            row = (part + n, key[0], dim, held[0]["c0"], held[-1]["c0"], y.min(0).tolist(), y.max(0).tolist(), [r["id"] for r in held], [r["n"] for r in held], vecs)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) >= BLOCK or (r["label"], r["dim"]) != key):
                    yield flush()
                    held, n = [], n + 1
                key = (r["label"], r["dim"])
                held.append(r)
        if held:
            yield flush()

    return run


class _Side:
    """A block with boxes of its leaves in the rotated leading dimensions."""

    def __init__(self, ids, counts, vecs: bytes, dim: int, base):
        self.ids, self.counts = np.array(ids, np.int64), np.array(counts, np.int64)
        self.x = _unit(np.frombuffer(vecs, np.float32).reshape(len(ids), dim))
        self.y = self.x @ base if base is not None else np.zeros((len(ids), 1))

    def box(self, a: int, z: int):
        return self.y[a:z].min(0), self.y[a:z].max(0)


def join_blocks(a: _Side, b: _Side, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each row of a and of b (weighed by the other's copies), and a forest over the linked rows' ids."""
    far = 2 - 2 * threshold + _SLACK
    la, lb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    parent: dict[int, int] = {}
    forest: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    stack = [(0, len(a.ids), 0, len(b.ids))]
    while stack:
        i, j, k, m = stack.pop()
        if same and m <= i:
            continue
        (al, ah), (bl, bh) = a.box(i, j), b.box(k, m)
        gap = np.maximum(0, np.maximum(al - bh, bl - ah))
        if gap @ gap > far:
            continue
        if j - i > LEAF or m - k > LEAF:
            if j - i >= m - k:
                h = (i + j) // 2
                stack += [(i, h, k, m), (h, j, k, m)]
            else:
                h = (k + m) // 2
                stack += [(i, j, k, h), (i, j, h, m)]
            continue
        hit = a.x[i:j] @ b.x[k:m].T >= threshold
        if same:
            hit &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
        if hit.any():
            la[i:j] += hit @ b.counts[k:m]
            lb[k:m] += hit.T @ a.counts[i:j]
            # each row to its first match, then matches of one row among themselves through it
            r, c = np.nonzero(hit)
            for u, v in zip(a.ids[i + r].tolist(), b.ids[k + c].tolist(), strict=True):
                p, q = root(u), root(v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    forest.append((u, v))
    if same:
        la = lb = la + lb
    return la, lb, forest


def _join(bases: dict[int, np.ndarray], threshold: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):  # a row at a time: each holds the blocks of two groups
                tile = b.slice(k, 1).to_pylist()[0]
                sides = {}
                for x in tile["blocks"]:
                    sides[x["bid"]] = _Side(x["ids"], x["counts"], x["vecs"], x["dim"], bases.get(x["dim"]))
                links: dict[int, np.ndarray] = {}
                ties: list[tuple[int, int]] = []
                for p, q in sorted((x["p"], x["q"]) for x in tile["pairs"]):
                    la, lb, forest = join_blocks(sides[p], sides[q], p == q, threshold)
                    links[p] = links.get(p, 0) + la
                    if p != q:
                        links[q] = links.get(q, 0) + lb
                    ties += forest
                for bid, n in links.items():
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(sides[bid].ids[at]), pa.array(n[at]), pa.nulls(len(at), pa.int64())], schema=schema)
                if ties:
                    u, v = zip(*ties, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([0] * len(u), pa.int64()), pa.array(v, pa.int64())], schema=schema)

    return run


def ego_join(vectors: DataFrame, scratch: Scratch, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Rows link when labels are equal and not null and their vectors, of equal length, have a cosine >= threshold. Null,
    empty and zero vectors, and those with a null or non-finite component, link with nothing. Repeated vec_ids count as
    rows of their own. A row without vec_id links nothing and has component_id and kept null. The rotation is fitted on
    at most SAMPLE vectors; it decides what is skipped, never what is found. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 3.5e38)) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # numbers are given once and written, so they are the same whenever they are read
    classes = scratch.save(rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "classes")
    bases = {}
    for r in classes.orderBy(F.xxhash64("first", "label"), "id").limit(SAMPLE).groupBy(F.size("embedding").alias("dim")).agg(F.collect_list("embedding").alias("xs")).collect():
        x = _unit(np.array(r["xs"], np.float32))
        _, axes = np.linalg.eigh(np.atleast_2d(np.cov(x.T)) if len(x) > 1 else np.eye(x.shape[1]))
        bases[r["dim"]] = np.ascontiguousarray(axes[:, ::-1][:, :DIMS])
    eps = float(np.sqrt(2 - 2 * threshold))
    order = ["label", "dim", *(f"c{i}" for i in range(DIMS)), "id"]
    celled = classes.select("label", "id", "n", "embedding").mapInArrow(_cells(bases, eps), "label long, id long, n long, dim int, vec binary, " + ", ".join(f"c{i} int" for i in range(DIMS)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = scratch.save(celled.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks(bases), _BLOCK), "blocks")
    meta = blocks.select("bid", "label", "dim", "lo", "hi", "low", "high")
    one = meta.select("label", "dim", F.col("bid").alias("p"), F.col("low").alias("l1"), F.col("high").alias("h1"), F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("c"))
    two = meta.select("label", "dim", F.col("bid").alias("q"), F.col("low").alias("l2"), F.col("high").alias("h2"), F.explode(F.sequence("lo", "hi")).alias("c"))
    gap = F.aggregate(F.arrays_zip("l1", "h1", "l2", "h2"), F.lit(0.0), lambda s, x: s + F.pow(F.greatest(F.lit(0.0), x["l1"] - x["h2"], x["l2"] - x["h1"]), F.lit(2.0)))
    pairs = one.join(two, ["label", "dim", "c"]).where((F.col("p") <= F.col("q")) & (gap <= 2 - 2 * threshold + _SLACK)).select("p", "q").distinct()
    # pairs are joined by tiles of two groups of neighbouring blocks, so a block is sent once a tile and not once a pair
    load = ["bid", "dim", "ids", "counts", "vecs"]
    tiles = scratch.save(pairs.withColumn("gp", F.floor(F.col("p") / GROUP).cast("long")).withColumn("gq", F.floor(F.col("q") / GROUP).cast("long")), "pairs")
    needed = tiles.select("gp", "gq", F.explode(F.array("p", "q")).alias("bid")).distinct()
    sent = blocks.select(*load).join(needed, "bid").groupBy("gp", "gq").agg(F.collect_list(F.struct(*load)).alias("blocks"))  # at most 2 * GROUP blocks a tile
    listed = tiles.groupBy("gp", "gq").agg(F.collect_list(F.struct("p", "q")).alias("pairs"))  # at most GROUP^2
    out = scratch.save(sent.join(listed, ["gp", "gq"]).select("blocks", "pairs").mapInArrow(_join(bases, threshold), "id long, links long, to long"), "links")
    counts = out.where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    found = connected_components(out.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")), scratch)
    member = scratch.save(classes.select("id", "first").join(found, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("component", "id").alias("group")), "members")
    named = member.groupBy("group").agg(F.min("first").alias("component"))
    known = classes.drop("first").join(counts, "id", "left").join(member.join(named, "group").select("id", "component"), "id")
    known = known.select(F.col("label").alias("kl"), F.col("embedding").alias("kv"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    joined = rows.withColumn("good", good).join(known, (F.col("label") == F.col("kl")) & (F.col("embedding") == F.col("kv")) & F.col("good"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
