"""Tensor trains as coordinate tables, and their sweeps.

A train is a table (core, a, i, c, v): core's entry at left rank a, mode i, right rank c. Contractions are
equi-joins with sums, so cores of any size stay distributed. Sweeps (orthogonalisation, truncation, index
selection) walk the cores one after another by definition; each core of a sweep fits the driver (see MAX_CORE).
Unfoldings put (mode, left rank) in rows with the left rank fastest, tensors flatten the first mode fastest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsieve.operators.registry import run_kernel

#: Most entries of a core in a sweep.
MAX_CORE = 20_000_000
SCHEMA = "core int, a int, i int, c int, v double"


def train_table(spark: SparkSession, cores: list[np.ndarray]) -> DataFrame:
    """Table of cores given as arrays (left, mode, right)."""
    check_ranks([g.shape for g in cores])
    return spark.createDataFrame(_entries(cores, ["core", "a", "i", "c"], pa.int32()))


def _entries(arrays: list[np.ndarray], names: list[str], kind: pa.DataType) -> pa.Table:
    """Coordinates (number of the array first) and values v of arrays of three axes, as Arrow columns."""
    parts = []
    for k, g in enumerate(arrays):
        at = [np.full(g.size, k), *(x.ravel() for x in np.indices(g.shape))]
        columns = [pa.array(at[0], pa.int32()), *(pa.array(x, kind) for x in at[1:]), pa.array(np.asarray(g, float).ravel())]
        parts.append(pa.Table.from_arrays(columns, [*names, "v"]))
    return pa.concat_tables(parts)


def check_ranks(shapes: list[tuple[int, int, int]]) -> None:
    """Boundary ranks are 1 and neighbouring ranks agree."""
    if not shapes or shapes[0][0] != 1 or shapes[-1][2] != 1 or any(x[2] != y[0] for x, y in zip(shapes, shapes[1:], strict=False)):
        raise ValueError("the ranks of neighbouring cores must agree and end in 1")


def shapes(train: DataFrame) -> DataFrame:
    """(core, left, mode, right)."""
    return train.groupBy("core").agg((F.max("a") + 1).alias("left"), (F.max("i") + 1).alias("mode"), (F.max("c") + 1).alias("right"))


def valid_chain(train: DataFrame) -> bool:
    s = shapes(train).withColumn("next", F.lead("left").over(Window.orderBy("core"))).withColumn("first", F.lag("right").over(Window.orderBy("core")))  # a row for each core
    return s.filter("(first IS NULL AND left <> 1) OR coalesce(next, 1) <> right").isEmpty()


def mode_slice(train: DataFrame, core: int, i: int) -> DataFrame:
    return train.filter((F.col("core") == core) & (F.col("i") == i)).select("a", "c", "v")


def set_mode_slice(train: DataFrame, core: int, i: int, values: DataFrame) -> DataFrame:
    rest = train.filter(~((F.col("core") == core) & (F.col("i") == i)))
    return rest.unionByName(values.select(F.lit(core).cast("int").alias("core"), "a", F.lit(i).cast("int").alias("i"), "c", "v"))


def zip_trains(operator: DataFrame, vector: DataFrame, out_sizes: dict[int, int]) -> DataFrame:
    """Applies a train of operators to a train: modes of `operator` are out + out_size * in, and `in` is summed.

    One join and one aggregate over all cores; bond (a, b) becomes a * (vector's rank) + b.
    """
    spark = operator.sparkSession
    sizes = spark.createDataFrame(list(out_sizes.items()), "core int, out_size int")
    left = operator.join(F.broadcast(sizes), "core").select("core", F.expr("i % out_size").alias("o"), F.expr("i div out_size").cast("int").alias("inner"), F.col("a").alias("a1"), F.col("c").alias("c1"), F.col("v").alias("v1"))  # a row for each core
    ranks = shapes(vector).select("core", F.col("left").alias("s0"), F.col("right").alias("s1"))
    right = vector.join(F.broadcast(ranks), "core").select("core", F.col("i").alias("inner"), F.col("a").alias("a2"), F.col("c").alias("c2"), F.col("v").alias("v2"), "s0", "s1")
    joined = left.join(right, ["core", "inner"])
    return joined.groupBy("core", (F.col("a1") * F.col("s0") + F.col("a2")).cast("int").alias("a"), F.col("o").cast("int").alias("i"), (F.col("c1") * F.col("s1") + F.col("c2")).cast("int").alias("c")).agg(F.sum(F.col("v1") * F.col("v2")).alias("v"))


def to_dense(train: DataFrame, modes: list[int]) -> DataFrame:
    """(index, v): the tensor, first mode fastest, by a chain of joins on ranks."""
    left = train.filter("core = 0").select(F.col("i").cast("bigint").alias("index"), F.col("c").alias("r"), "v")
    stride = modes[0]
    for k in range(1, len(modes)):
        core = train.filter(F.col("core") == k).select(F.col("a").alias("r"), F.col("i").alias("i2"), F.col("c").alias("c2"), F.col("v").alias("v2"))
        left = left.join(core, "r").groupBy((F.col("index") + F.col("i2") * stride).alias("index"), F.col("c2").alias("r")).agg(F.sum(F.col("v") * F.col("v2")).alias("v"))
        stride *= modes[k]
    return left.select("index", "v")


def absorb_left(train: DataFrame, core: int, factor: DataFrame) -> DataFrame:
    """R (p, q, v) applied to the left rank of a core."""
    g = train.filter(F.col("core") == core).select(F.col("a").alias("q"), "i", "c", F.col("v").alias("g"))
    return factor.join(g, "q").groupBy(F.col("p").alias("a"), "i", "c").agg(F.sum(F.col("v") * F.col("g")).alias("v"))


def absorb_right(train: DataFrame, core: int, factor: DataFrame) -> DataFrame:
    """R (p, q, v) applied to the right rank of a core: entries q of the rank are summed into p."""
    g = train.filter(F.col("core") == core).select("a", "i", F.col("c").alias("q"), F.col("v").alias("g"))
    return factor.join(g, "q").groupBy("a", "i", F.col("p").alias("c")).agg(F.sum(F.col("v") * F.col("g")).alias("v"))


def truncated_rank(values: DataFrame, atol: float, rtol: float) -> DataFrame:
    """(r): the least number of leading singular values (idx, s) whose dropped tail has norm within max(atol, rtol * norm), one at least."""
    tail = Window.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each singular value of one core
    limit = F.greatest(F.lit(atol), F.lit(rtol) * F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy())))
    kept = values.select("idx", F.sum(F.col("s") * F.col("s")).over(tail).alias("t"), limit.alias("limit")).filter("t > limit * limit")
    return kept.agg(F.greatest(F.lit(1), F.count(F.lit(1))).cast("int").alias("r"))


def fibers_add(x: DataFrame, y: DataFrame) -> DataFrame:
    return _combined(x, y, F.col("v") + F.col("w"))


def fibers_hadamard(x: DataFrame, y: DataFrame) -> DataFrame:
    return _combined(x, y, F.col("v") * F.col("w"))


def _combined(x: DataFrame, y: DataFrame, value) -> DataFrame:  # noqa: ANN001
    """Entry by entry; both must hold values on one skeleton, so an entry without a partner is an error."""
    keys = ["skel_id", "core", "left_node", "mode", "right_node"]
    joined = x.join(y.withColumnRenamed("v", "w"), keys, "full_outer")
    ok = F.col("v").isNotNull() & F.col("w").isNotNull()
    return joined.select(*keys, F.when(ok, value).otherwise(F.raise_error(F.lit("the fibers lie on different skeletons")).cast("double")).alias("v"))


# --- sweeps ---------------------------------------------------------------------------------------


def collect_cores(train: DataFrame) -> list[np.ndarray]:
    sizes = {r["core"]: (r["left"], r["mode"], r["right"]) for r in shapes(train).collect()}
    if any(np.prod(s, dtype=float) > MAX_CORE for s in sizes.values()):
        raise ValueError("a core is too large for a sweep")
    cores = [np.zeros(sizes[k]) for k in sorted(sizes)]
    for at, k in enumerate(sorted(sizes)):  # one core at a time, as Arrow columns
        a, i, c, v = (x.to_numpy() for x in train.filter(F.col("core") == k).select("a", "i", "c", "v").toArrow().columns)
        cores[at][a, i, c] = v
    return cores


def left_unfolding(g: np.ndarray) -> np.ndarray:
    return g.transpose(1, 0, 2).reshape(-1, g.shape[2])  # rows: mode, then left rank fastest


def _from_left(u: np.ndarray, left: int, mode: int) -> np.ndarray:
    return u.reshape(mode, left, -1).transpose(1, 0, 2)


def left_orthogonalize(cores: list[np.ndarray]) -> list[np.ndarray]:
    out = [g.copy() for g in cores]
    for k in range(len(out) - 1):
        q, r = np.linalg.qr(left_unfolding(out[k]))
        out[k] = _from_left(q, out[k].shape[0], out[k].shape[1])
        out[k + 1] = np.einsum("pa,aic->pic", r, out[k + 1])
    return out


def right_orthogonalize(cores: list[np.ndarray]) -> list[np.ndarray]:
    return [g.transpose(2, 1, 0) for g in left_orthogonalize([g.transpose(2, 1, 0) for g in cores[::-1]])][::-1]


def rank_of(s: np.ndarray, atol: float, rtol: float) -> int:
    limit = max(atol, rtol * float(np.linalg.norm(s)))
    tails = np.sqrt(np.cumsum((s**2)[::-1]))[::-1]
    return max(1, int((tails > limit).sum()))


def left_svd(g: np.ndarray, atol: float = 0.0, rtol: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """An orthogonal core and the factor that the next one absorbs."""
    u, s, w = np.linalg.svd(left_unfolding(g), full_matrices=False)
    r = rank_of(s, atol, rtol)
    return _from_left(u[:, :r], g.shape[0], g.shape[1]), s[:r, None] * w[:r]


def right_svd(g: np.ndarray, atol: float = 0.0, rtol: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    core, carry = left_svd(g.transpose(2, 1, 0), atol, rtol)
    return core.transpose(2, 1, 0), carry.T


def compress(cores: list[np.ndarray], atol: float = 0.0, rtol: float = 0.0) -> list[np.ndarray]:
    """Right orthogonalisation, then truncating decompositions from the left."""
    out = right_orthogonalize(cores)
    for k in range(len(out) - 1):
        out[k], carry = left_svd(out[k], atol, rtol)
        out[k + 1] = np.einsum("pa,aic->pic", carry, out[k + 1])
    return out


def dense(cores: list[np.ndarray]) -> np.ndarray:
    t = cores[0]
    for g in cores[1:]:
        t = np.tensordot(t, g, axes=(t.ndim - 1, 0))
    return t.reshape(t.shape[1:-1])


@dataclass
class Skeleton:
    """Nested index trees: per bond a list of (mode, parent) nodes; parent -1 is the root.

    left[b] extends left[b-1] by mode b; right[b] gives modes b+1.. and its parents are nodes of right[b+1].
    """

    modes: list[int]
    left: list[list[tuple[int, int]]]
    right: list[list[tuple[int, int]]]

    def left_count(self, core: int) -> int:
        return 1 if core == 0 else len(self.left[core - 1])

    def right_count(self, core: int) -> int:
        return 1 if core == len(self.modes) - 1 else len(self.right[core])

    def table(self, spark: SparkSession, skel_id: int = 0) -> DataFrame:
        rows = [(skel_id, side, b, node, mode, parent) for side, trees in (("left", self.left), ("right", self.right)) for b, level in enumerate(trees) for node, (mode, parent) in enumerate(level)]
        return spark.createDataFrame(rows, "skel_id bigint, side string, bond int, node bigint, mode bigint, parent bigint")

    def left_tuple(self, bond: int, node: int) -> tuple[int, ...]:
        mode, parent = self.left[bond][node]
        return (*(self.left_tuple(bond - 1, parent) if bond else ()), mode)

    def right_tuple(self, bond: int, node: int) -> tuple[int, ...]:
        mode, parent = self.right[bond][node]
        return (mode, *(self.right_tuple(bond + 1, parent) if bond + 1 < len(self.right) else ()))


def fibers_of(cores: list[np.ndarray], skeleton: Skeleton) -> list[np.ndarray]:
    """Slabs (left nodes, mode, right nodes): the train at every index that the skeleton names."""
    d = len(cores)
    lefts, rights = [np.ones((1, 1))], [np.ones((1, 1))]
    for b in range(d - 1):
        lefts.append(np.array([lefts[b][max(parent, 0)] @ cores[b][:, mode, :] for mode, parent in skeleton.left[b]]))
    for b in range(d - 2, -1, -1):
        rights.append(np.array([cores[b + 1][:, mode, :] @ rights[-1][max(parent, 0)] for mode, parent in skeleton.right[b]]))
    rights = rights[::-1]
    return [np.einsum("pa,aic,qc->piq", lefts[k], cores[k], rights[k]) for k in range(d)]


def select_indices(cores: list[np.ndarray], selector: str = "dominant", atol: float = 0.0, rtol: float = 1e-10, oversampling: int = 0, **params) -> tuple[Skeleton, list[np.ndarray]]:
    """A skeleton by subset selection on the unfoldings, right to left and then left to right, and the train's slabs on it."""
    d, modes = len(cores), [g.shape[1] for g in cores]
    if selector == "dominant":
        params.setdefault("c", 1.0)
    work = left_orthogonalize(cores)

    def chosen(x: np.ndarray) -> list[int]:
        k = min(x.shape[1], x.shape[0] + oversampling)
        return sorted(run_kernel(selector, x, k, **params)[0])

    right: list[list[tuple[int, int]]] = [[] for _ in range(d - 1)]
    below = np.ones((1, 1))  # the right factor at the nodes of the next bond
    for k in range(d - 1, 0, -1):
        core, carry = right_svd(work[k], atol, rtol)
        work[k - 1] = np.einsum("aic,cp->aip", work[k - 1], carry)
        x = np.einsum("aic,qc->aiq", core, below)  # columns (mode, parent)
        flat = x.reshape(x.shape[0], -1)
        picks = chosen(flat)
        right[k - 1] = [(p // x.shape[2], p % x.shape[2] if k < d - 1 else -1) for p in picks]
        work[k], below = core, flat[:, picks].T
    left: list[list[tuple[int, int]]] = [[] for _ in range(d - 1)]
    above = np.ones((1, 1))
    for k in range(d - 1):
        x = np.einsum("pa,aic->pic", above, work[k])
        q, r = np.linalg.qr(x.transpose(1, 0, 2).reshape(-1, x.shape[2]))  # rows: parent + parents * mode
        work[k + 1] = np.einsum("pa,aic->pic", r, work[k + 1])
        picks = chosen(q.T)
        left[k] = [(p // x.shape[0], p % x.shape[0] if k else -1) for p in picks]
        above = q[picks]
    skeleton = Skeleton(modes, left, right)
    return skeleton, fibers_of(cores, skeleton)


def cores_from_fibers(slabs: list[np.ndarray], skeleton: Skeleton) -> list[np.ndarray]:
    """Cross interpolation: each slab is orthogonalised and the next absorbs the pseudoinverse at the chosen rows."""
    d, out = len(slabs), []
    carry = np.ones((1, 1))
    for k in range(d - 1):
        g = np.einsum("ap,piq->aiq", carry, slabs[k])
        q, _r = np.linalg.qr(left_unfolding(g))
        core = _from_left(q, g.shape[0], g.shape[1])
        at = np.array([(lefts @ core[:, mode, :]) for mode, lefts in ((m, _left_row(out, skeleton, k, p)) for m, p in skeleton.left[k])])
        out.append(core)
        carry = np.linalg.pinv(at)
    out.append(np.einsum("ap,piq->aiq", carry, slabs[-1]))
    return out


def _left_row(cores: list[np.ndarray], skeleton: Skeleton, bond: int, parent: int) -> np.ndarray:
    """The orthogonal cores before `bond` at a parent node."""
    row = np.ones(1)
    if bond == 0:
        return row
    for k, mode in enumerate(skeleton.left_tuple(bond - 1, parent)):
        row = row @ cores[k][:, mode, :]
    return row


def fibers_table(spark: SparkSession, slabs: list[np.ndarray], skel_id: int = 0) -> DataFrame:
    entries = spark.createDataFrame(_entries(slabs, ["core", "left_node", "mode", "right_node"], pa.int64()))
    return entries.select(F.lit(skel_id).cast("bigint").alias("skel_id"), "*")
