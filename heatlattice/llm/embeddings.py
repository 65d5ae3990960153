"""Exact near-duplicate vectors by a metric range join over pivots.

Vectors that are equal, up to a power of two as a factor, collapse to one class. On the unit sphere the angle is a metric;
the link radius is eps = arccos(threshold). Pivots, one for each CELL vectors but CELLS wherever each can have LEAST vectors,
cut the sphere into cells by nearest pivot.
A vector x of cell i must meet the vectors of an earlier cell j only if angle(x, p_j) <= angle(x, p_i) + 2 eps and
angle(x, p_j) <= radius_j + eps, by the triangle inequality; such cells get a replica. A first narrow pass counts each
cell's replicas, so that blocks are dealt for the replicas there are. Cells then join independently, in blocks of at
most about BLOCK vectors: a large cell is dealt to many tasks, each of two blocks. A block returns sums and a spanning forest of
its links, never the pairs. Products of unit vectors decide all pairs but those within MARGIN of the threshold; these are
computed again from the vectors as given, by one formula that does not depend on the blocks. Vectors of different length
never meet.

In data without low-dimensional structure the triangle inequality excludes little, and the work is that of all blocks;
that is inherent to an exact join. Pivots take at most PIVOT_BYTES; beyond that cells grow, and stay exact.

Defined cases: null, empty or zero vectors and those with null or non-finite components have no link and are their own
component; equal vectors link with each other; rows with a null vec_id take part in nobody's component and get null;
rows that share a vec_id are separate vectors under one name; labels are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, staged

THRESHOLD, MARGIN = 0.9, 1e-9
#: Vectors of a cell on average and, where there are fewer, cells there are at least; vectors of a block.
CELL, CELLS, LEAST, BLOCK = 16384, 8, 16, 16384
#: Bytes of all pivots, pivots of one length chosen farthest first, and sampled vectors for each pivot.
PIVOT_BYTES, FARTHEST, SAMPLE = 64 << 20, 512, 8
ROWS = 4096


def _cleaned(kind: str):
    """(vec_id, key, dim, vector): the digest of the vector up to a power of two, and its components as they are."""

    def run(batches):
        for batch in batches:
            column, ids = batch.column("embedding"), batch.column("vec_id")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null: NaN
            named = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            keys: list[bytes | None] = [None] * len(lengths)
            raws: list[bytes | None] = [None] * len(lengths)
            for d in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero((lengths == d) & named)
                v = values[starts[at][:, None] + np.arange(d)]
                top = np.abs(v).max(1)  # NaN if there is one
                at, v, top = (x[np.isfinite(top) & (top > 0)] for x in (at, v, top))
                scaled = np.ldexp(v, -np.frexp(top)[1][:, None])
                plain = (v if kind == "<f4" else scaled).astype(kind)
                for i, row, own in zip(at.tolist(), scaled, plain, strict=True):
                    keys[i], raws[i] = hashlib.md5(row.tobytes(), usedforsecurity=False).digest(), own.tobytes()
            dims = np.where([k is not None for k in keys], lengths, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(dims), pa.array(raws, pa.binary())], names=["vec_id", "key", "dim", "vector"])

    return run


def _matrix(raws: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def _angles(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ p.T, -1.0, 1.0))


def choose_pivots(sample: np.ndarray, k: int, farthest: int = FARTHEST) -> np.ndarray:
    """Farthest-first traversal; beyond `farthest` pivots, those that lie farthest from these."""
    chosen = [0]
    nearest = _angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(k, farthest, len(sample)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, _angles(sample, sample[chosen[-1:]])[:, 0])
    if len(chosen) < min(k, len(sample)):
        nearest[chosen] = -1.0
        chosen += np.argsort(-nearest, kind="stable")[: min(k, len(sample)) - len(chosen)].tolist()
    return sample[chosen]


def _by_dim(batch: pa.RecordBatch, kind: str, pivots: dict[int, np.ndarray]):
    """(d, rows, unit vectors) of bounded parts of a batch, for the lengths that have pivots."""
    dims, raws = batch.column("dim").to_numpy(), batch.column("vector")
    for d, p in pivots.items():
        at = np.flatnonzero(dims == d)
        step = max(1, (1 << 22) // len(p))
        for s in range(0, len(at), step):
            part = at[s : s + step]
            yield d, part, _units(_matrix(raws.take(pa.array(part)).to_pylist(), kind))


def _assigned(kind: str, pivots):
    def run(batches):
        for batch in batches:
            cell, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for d, part, unit in _by_dim(batch, kind, pivots.value):
                a = _angles(unit, pivots.value[d])
                cell[part], angle[part] = a.argmin(1), a.min(1)
            names = ["id", "copies", "key", "dim", "vector"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(cell), pa.array(angle)], names=[*names, "cell", "angle"])

    return run


def _replicated(batch: pa.RecordBatch, kind: str, pivots: dict, radius: dict, eps: float):
    """(d, rows, cells): which rows the triangle inequality sends to which earlier cells."""
    cell, angle = batch.column("cell").to_numpy(), batch.column("angle").to_numpy()
    for d, part, unit in _by_dim(batch, kind, pivots):
        far = _angles(unit, pivots[d])
        on = (far <= angle[part][:, None] + (2 * eps + 1e-9)) & (far <= radius[d] + (eps + 1e-9)) & (np.arange(far.shape[1]) < cell[part][:, None])
        i, j = np.nonzero(on)
        yield d, part[i], j


def _counted(kind: str, pivots, radius, eps: float):
    """(dim, cell, n): replicas of this task's rows."""

    def run(batches):
        total = {d: np.zeros(len(p), np.int64) for d, p in pivots.value.items()}
        for batch in batches:
            for d, _, j in _replicated(batch, kind, pivots.value, radius.value, eps):
                total[d] += np.bincount(j, minlength=len(total[d]))
        rows = [(d, int(j), int(n[j])) for d, n in total.items() for j in np.flatnonzero(n)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["dim", "cell", "n"])

    return run


def _each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: the index of each count n times over, and 0, 1, ... within each."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _dealt(kind: str, pivots, radius, plan, eps: float):
    """Rows for the blocks (dim, cell, kind, a, b): side 0 is core block a; side 1 is core block b or replica block b."""

    def run(batches):
        names = ["dim", "cell", "kind", "a", "b", "side", "id", "copies", "vector"]
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                batch = whole.slice(s, ROWS)
                dims, cell = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
                h = np.frombuffer(b"".join(batch.column("key").to_pylist()), "<u4").reshape(-1, 4).astype(np.int64)
                own = [plan.value[x] for x in zip(dims.tolist(), cell.tolist(), strict=True)]
                cores, reps = (np.array([x[k] for x in own], np.int64) for k in (0, 1))
                a = h[:, 0] % cores
                row, b = _each(cores)
                parts = [(row, cell[row], 0, np.minimum(a[row], b), np.maximum(a[row], b), (a[row] > b).astype(np.int32))]
                row, b = _each(reps)
                parts.append((row, cell[row], 1, a[row], b, np.zeros(len(row), np.int32)))
                for d, i, j in _replicated(batch, kind, pivots.value, radius.value, eps):
                    to = [plan.value[d, x] for x in j.tolist()]
                    if to:
                        cores_j, reps_j = (np.array([x[k] for x in to], np.int64) for k in (0, 1))
                        copy, block = _each(cores_j)
                        parts.append((i[copy], j[copy], 1, block, (h[i, 1] % reps_j)[copy], np.ones(len(copy), np.int32)))
                for row, c, k, lo, hi, side in parts:
                    for t in range(0, len(row), ROWS):
                        r, cut = row[t : t + ROWS], slice(t, t + ROWS)
                        got = [np.full(len(r), k), lo[cut], hi[cut], side[cut]]
                        at = pa.array(r)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(dims[r]), *(pa.array(x.astype(np.int32)) for x in (c[cut], *got)), *(batch.column(x).take(at) for x in ("id", "copies", "vector"))],
                            names=names,
                        )

    return run


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b in double precision, the same whatever else is computed with them."""
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    up = parent[at]
    while (up != (top := parent[up])).any():
        up = top
    return up


def _linked(x: np.ndarray, y: np.ndarray, same: bool, threshold: float):
    """Links of rows of x with rows of y (those behind them, if same), a bounded number of x's rows at a time."""
    u, v = _units(x), _units(y).T
    step = max(1, (1 << 22) // max(1, len(y)))
    for s in range(0, len(x), step):
        got = u[s : s + step] @ v
        i, j = np.nonzero(got >= threshold + MARGIN)
        ii, jj = np.nonzero(np.abs(got - threshold) < MARGIN)
        for t in range(0, len(ii), 1 << 14):
            p, q = ii[t : t + (1 << 14)], jj[t : t + (1 << 14)]
            on = exact_cosine(x[s + p], y[q]) >= threshold
            i, j = np.concatenate([i, p[on]]), np.concatenate([j, q[on]])
        if same:
            on = i + s < j
            i, j = i[on], j[on]
        yield i + s, j


def _joined(kind: str, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = table["kind"][0].as_py() == 0 and table["a"][0].as_py() == table["b"][0].as_py()
        if same:
            left = right = np.arange(len(ids))
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(left) and len(right):
            x, y = (_matrix(table["vector"].take(pa.array(at)).to_pylist(), kind) for at in (left, right))
            for i, j in _linked(x, y, same, threshold):
                i, j = left[i], right[j]
                links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                while len(i):  # hook larger roots onto smaller ones until both ends of every link agree
                    p, q = _roots(parent, i), _roots(parent, j)
                    on = p != q
                    i, j, p, q = i[on], j[on], p[on], q[on]
                    np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        hit = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[hit]), "links": pa.array(links[hit]), "other": pa.array(ids[_roots(parent, hit)])})

    return run


def link_components(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    rows = staged(slim.mapInArrow(_cleaned(kind), "vec_id long, key binary, dim int, vector binary"), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    classes = staged(classes, "classes")

    pivots = {}
    full = classes.groupBy("dim").count().where(F.col("count") >= 2 * LEAST).collect()  # lengths with enough vectors for two cells
    for dim, n in full:
        k = max(2, min(max(-(-n // CELL), min(CELLS, n // LEAST)), PIVOT_BYTES // (8 * dim * len(full))))
        sample = classes.where(F.col("dim") == dim).orderBy("key").select("vector").limit(SAMPLE * k).toArrow()  # keys are digests
        pivots[dim] = choose_pivots(_units(_matrix(sample["vector"].to_pylist(), kind)), k)
    sent = spark.sparkContext.broadcast(pivots)
    fields = "id long, copies long, key binary, dim int, vector binary, cell int, angle double"
    placed = staged(classes.select("id", "copies", "key", "dim", "vector").mapInArrow(_assigned(kind, sent), fields), "cells")
    eps = float(np.arccos(threshold))
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row for each pivot
    radius = {d: np.full(len(p), -np.inf) for d, p in pivots.items()}  # cells without vectors take no replica
    for r in cells:
        if r["dim"] in radius:
            radius[r["dim"]][r["cell"]] = r["radius"]
    reach = spark.sparkContext.broadcast(radius)
    counted = placed.mapInArrow(_counted(kind, sent, reach, eps), "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n"))
    replicas = {(r["dim"], r["cell"]): r["n"] for r in counted.collect()}  # a row for each pivot at most
    plan = {(r["dim"], r["cell"]): (-(-r["n"] // BLOCK), -(-replicas.get((r["dim"], r["cell"]), 0) // BLOCK)) for r in cells}
    dealt = placed.mapInArrow(
        _dealt(kind, sent, reach, spark.sparkContext.broadcast(plan), eps),
        "dim int, cell int, kind int, a int, b int, side int, id long, copies long, vector binary",
    )
    found = staged(dealt.groupBy("dim", "cell", "kind", "a", "b").applyInArrow(_joined(kind, threshold), "id long, links long, other long"), "links")
    discard(placed)
    group = components(found, "id", "other")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = (
        classes.select("key", "id", "copies")
        .join(links, "id", "left")
        .join(group, F.col("id") == F.col("node"), "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    out = rows.select("vec_id", "key").join(per_class, "key", "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))


ORACLE = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9::double),
r(a, b) as (select vec_id, vec_id from v union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component_id, vec_id)::bigint as component_id, vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id"""
