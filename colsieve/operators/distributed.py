"""Selection over a matrix too wide for one task: passes over the columns with m x m state on the driver.

Each pick is one aggregate (max_by over a score expression) and a rank-one update of Y; scores are
recomputed from Y, so the plan of a pass doesn't grow with the picks. Whitened columns are written once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsieve.functions.linalg import dot, gram_matrix, matrix_literal, whiten
from colsieve.functions.rng import uniform
from colsieve.session import materialize, remove_dir, shared_dir


def _vec() -> Column:
    return F.col("vec")


#: Matrix rows up to which Y is a literal of the plan; beyond, Arrow batches are multiplied with it in the tasks.
LITERAL_ROWS = 16
#: Doubles of the vectors that a pass of volume removal brings to the driver, and of pairs that a task of an exchange holds at once.
HELD_DOUBLES = 4_000_000


def quadratic(y: np.ndarray) -> Column:
    """v^T Y v."""
    if len(y) > LITERAL_ROWS:
        return _batched(y)
    return dot(F.transform(matrix_literal(y), lambda row: dot(row, _vec())), _vec())


def _prepared(df: DataFrame) -> tuple[DataFrame, int, int]:
    q = materialize(whiten(df).select("col_id", "vec"), "whitened")
    first = q.select(F.size("vec").alias("m")).first()
    return q, first["m"], q.count()


def _checked(m: int, n: int, k: int) -> None:
    if not 1 <= m <= k <= n:
        raise ValueError(f"1 <= m <= k <= n doesn't hold: m={m}, k={k}, n={n}")


def _outside(q: DataFrame, chosen: list[int]) -> DataFrame:
    return q.filter(~F.col("col_id").isin(chosen)) if chosen else q


def _pick(q: DataFrame, score: Column, largest: bool = True) -> tuple[int, np.ndarray, float]:
    """(col_id, vec, score) of the best score; equal scores (to nine digits) go to the lowest id."""
    s = score if largest else -score
    row = q.select("col_id", "vec", s.alias("s")).agg(F.max_by(F.struct("col_id", "vec", "s"), F.struct(F.round("s", 9).alias("s"), (-F.col("col_id")).alias("i"))).alias("r")).first()["r"]
    return row["col_id"], np.array(row["vec"]), row["s"] if largest else -row["s"]


def _result(q: DataFrame, algorithm: str, k: int, chosen: list[int], swaps: int | None = None) -> DataFrame:
    spark = q.sparkSession
    rows = [(0, algorithm, k, rank, int(c), swaps) for rank, c in enumerate(chosen)]
    return spark.createDataFrame(rows, "matrix_id bigint, algorithm string, k int, rank int, col_id bigint, swap_count bigint")


def _ranked(df: DataFrame, algorithm: str, k: int) -> DataFrame:
    """A top-k of rows (col_id, key) with the smallest keys, as selection rows."""
    top = df.orderBy("key", "col_id").limit(k)
    return top.select(F.lit(0).cast("bigint").alias("matrix_id"), F.lit(algorithm).alias("algorithm"), F.lit(k).alias("k"), F.lit(None).cast("int").alias("rank"), "col_id", F.lit(None).cast("bigint").alias("swap_count"))


def _checked_rows(df: DataFrame, k: int) -> None:
    """The contract, from the row count and one vector."""
    first = df.select(F.size("vec").alias("m")).first()
    _checked(first["m"] if first else 0, df.count(), k)


def random_columns(df: DataFrame, k: int, seed: int = 0, call: int = 0, trial: int = 0, **_) -> DataFrame:
    """A uniform k-subset: the k smallest uniforms. Reads no vectors but one, for the contract."""
    _checked_rows(df, k)
    return _ranked(df.select("col_id", uniform(seed, call, trial, F.col("col_id")).alias("key")), "random columns", k)


def leverage_scores(df: DataFrame, k: int, seed: int = 0, call: int = 0, trial: int = 0, **_) -> DataFrame:
    """Weighted sampling without replacement by leverage: the k largest log(u) / w."""
    _checked_rows(df, k)
    w = dot(_vec(), _vec())
    key = F.when(w > 0, -F.log(uniform(seed, call, trial, F.col("col_id"))) / w).otherwise(F.lit(float("inf")))
    return _ranked(whiten(df).select("col_id", key.alias("key")), "leverage scores", k)


def _cpqr(q: DataFrame, count: int) -> tuple[list[int], list[np.ndarray]]:
    m = count
    left, chosen, vectors = np.eye(m), [], []
    for _ in range(count):
        c, v, _s = _pick(_outside(q, chosen), quadratic(left))
        r = left @ v
        left = left - np.outer(r, r) / float(r @ r)
        chosen.append(c)
        vectors.append(v)
    return chosen, vectors


def cpqr_start(df: DataFrame, k: int | None = None, **_) -> DataFrame:
    """m pivots, each with the largest residual norm."""
    q, m, n = _prepared(df)
    return _result(q, "cpqr", k or m, _cpqr(q, m)[0])


def _grown(q: DataFrame, chosen: list[int], y: np.ndarray, k: int, score: Callable[[np.ndarray], Column]) -> tuple[list[int], np.ndarray]:
    while len(chosen) < k:
        c, v, _s = _pick(_outside(q, chosen), score(y))
        u = y @ v
        y = y - np.outer(u, u) / (1 + float(v @ u))
        chosen = [*chosen, c]
    return chosen, y


def greedy_volume(df: DataFrame, k: int, **_) -> DataFrame:
    """Pivots, then the largest leverage until there are k (the greedy start)."""
    q, m, n = _prepared(df)
    _checked(m, n, k)
    chosen, vectors = _cpqr(q, m)
    x = np.array(vectors).T
    return _result(q, "greedy volume", k, _grown(q, chosen, np.linalg.inv(x @ x.T), k, quadratic)[0])


def frobenius_selection(df: DataFrame, k: int, **_) -> DataFrame:
    q, m, n = _prepared(df)
    _checked(m, n, k)
    chosen: list[int] = []
    vectors: list[np.ndarray] = []
    for _step in range(m):
        if chosen:
            x = np.array(vectors).T
            basis = np.linalg.pinv(x)
            residual = np.eye(m) - x @ basis
            cost, rest = F.lit(1.0) + quadratic(basis.T @ basis), quadratic(residual)
        else:
            cost, rest = F.lit(1.0), quadratic(np.eye(m))
        c, v, _s = _pick(_outside(q, chosen), F.when(rest > 1e-14, cost / rest).otherwise(F.lit(1e300)), largest=False)
        chosen.append(c)
        vectors.append(v)
    x = np.array(vectors).T
    chosen, _y = _grown(q, chosen, np.linalg.inv(x @ x.T), k, lambda y: quadratic(y @ y) / (1 + quadratic(y)))
    return _result(q, "frobenius selection", k, chosen)


def _exchangeable(df: DataFrame, k: int, c: float, initialization: str) -> tuple[DataFrame, int, int]:
    if c < 1:
        raise ValueError("c must be at least 1")
    if initialization not in ("cpqr", "greedy"):
        raise ValueError(f"the distributed form starts from 'cpqr' or 'greedy', not from {initialization!r}")
    q, m, n = _prepared(df)
    _checked(m, n, k)
    return q, m, n


def _swap_cap(m: int, k: int, c: float) -> float:
    return math.inf if c == 1 else math.ceil(2 * m * math.log(k) / math.log(c))


def _start(q: DataFrame, m: int, k: int, initialization: str) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """k ids, their vectors and Y: m pivots, then the lowest ids ("cpqr") or the largest leverages ("greedy")."""
    chosen, vectors = _cpqr(q, m)
    if initialization == "cpqr":
        rest = _outside(q, chosen).orderBy("col_id").limit(k - m).collect()  # k vectors are held anyway
        chosen, vectors = chosen + [r["col_id"] for r in rest], vectors + [np.array(r["vec"]) for r in rest]
    x = np.array(vectors).T
    y = np.linalg.inv(x @ x.T)
    while len(chosen) < k:
        i, v, _s = _pick(_outside(q, chosen), quadratic(y))
        u = y @ v
        y = y - np.outer(u, u) / (1 + float(v @ u))
        chosen.append(i)
        vectors.append(v)
    return chosen, vectors, y


def volume_add_remove(df: DataFrame, k: int, c: float = 1.0, initialization: str = "greedy", **_) -> DataFrame:
    """Two picks for each exchange: the best addition by a pass, the best removal among the k chosen vectors.

    initialization: "cpqr" (m pivots, then the lowest ids) or "greedy" (then the largest leverages); "advanced" is for the kernel only.
    """
    q, m, n = _exchangeable(df, k, c, initialization)
    chosen, vectors, y = _start(q, m, k, initialization)
    cap, swaps = _swap_cap(m, k, c), 0
    while swaps < cap and len(chosen) < n:
        i, v, gain = _pick(_outside(q, chosen), quadratic(y))
        u = y @ v
        after = y - np.outer(u, u) / (1 + float(v @ u))
        held = np.array(vectors)
        loss = np.einsum("ij,jk,ik->i", held, after, held)
        r = min(range(k), key=lambda p: (round(loss[p], 9), chosen[p]))
        if (1 + gain) * (1 - loss[r]) <= c * (1 + 1e-10):
            break
        chosen[r], vectors[r] = i, v
        x = np.array(vectors).T
        y = np.linalg.inv(x @ x.T)
        swaps += 1
    return _result(q, "volume add-remove", k, chosen, swaps)


def forward_volume(df: DataFrame, k: int, seed: int = 0, call: int = 0, trial: int = 0, **_) -> DataFrame:
    """m exact draws in proportion to squared residuals, one aggregate each, then a uniform rest."""
    q, m, n = _prepared(df)
    _checked(m, n, k)
    left, chosen = np.eye(m), []
    for step in range(m):
        p = quadratic(left)
        key = F.when(p > 1e-300, F.log(uniform(seed, call, trial, F.concat_ws("|", F.lit(str(step)), F.col("col_id").cast("string")))) / p).otherwise(F.lit(-1e300))
        c, v, _s = _pick(_outside(q, chosen), key)
        r = left @ v
        left = left - np.outer(r, r) / float(r @ r)
        chosen.append(c)
    rest = _outside(q, chosen).select("col_id", uniform(seed, call, trial, F.concat_ws("|", F.lit("rest"), F.col("col_id").cast("string"))).alias("u")).orderBy("u", "col_id").limit(k - m)
    return _result(q, "forward iterative volume sampling", k, chosen + [r["col_id"] for r in rest.collect()])


def _rows(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _batched(y: np.ndarray) -> Column:
    """v^T Y v in Arrow batches, for the m x m of wide vectors."""

    @F.arrow_udf("double")
    def form(v: pa.Array) -> pa.Array:
        x = _rows(v)
        return pa.array(np.einsum("ij,ij->i", x @ y, x))

    return form(_vec())


def _exchange(y: np.ndarray, held: np.ndarray, loss: np.ndarray) -> Column:
    """The largest gain of a column in place of a held one, (1 + v^T Y v) * loss + (held Y v)^2, and which one goes."""
    left = held @ y

    @F.arrow_udf("struct<gain double, at int>")
    def largest(v: pa.Array) -> pa.Array:
        x = _rows(v)
        gain, at = np.empty(len(x)), np.empty(len(x), np.int32)
        step = max(1, HELD_DOUBLES // len(held))
        for s in range(0, len(x), step):
            part = x[s : s + step]
            pairs = np.outer(1 + np.einsum("ij,ij->i", part @ y, part), loss) + (part @ left.T) ** 2
            at[s : s + step] = np.round(pairs, 9).argmax(axis=1)
            gain[s : s + step] = pairs[np.arange(len(part)), at[s : s + step]]
        return pa.StructArray.from_arrays([pa.array(gain), pa.array(at)], ["gain", "at"])

    return largest(_vec())


def _best_exchange(q: DataFrame, chosen: list[int], score: Column) -> tuple[int, np.ndarray, float, int]:
    """(col_id, vec, gain, position of the held column) of the best pair; ties go to the lowest held id, then the lowest new one."""
    scored = _outside(q, chosen).select("col_id", "vec", score.alias("e"))
    first = F.struct(F.round("e.gain", 9).alias("gain"), (-F.col("e.at")).alias("at"), (-F.col("col_id")).alias("i"))
    row = scored.agg(F.max_by(F.struct("col_id", "vec", "e"), first).alias("r")).first()["r"]
    return row["col_id"], np.array(row["vec"]), row["e"]["gain"], row["e"]["at"]


def dominant(df: DataFrame, k: int, c: float = 1.0, initialization: str = "greedy", **_) -> DataFrame:
    """A pass for each exchange: every column outside meets the k chosen ones in its task, and the best pair is one aggregate."""
    q, m, n = _exchangeable(df, k, c, initialization)
    chosen, vectors, _y = _start(q, m, k, initialization)
    cap, swaps = _swap_cap(m, k, c), 0
    while swaps < cap and len(chosen) < n:
        inside = sorted(range(k), key=lambda p: chosen[p])
        held = np.array([vectors[p] for p in inside])
        y = np.linalg.inv(held.T @ held)
        i, v, gain, at = _best_exchange(q, chosen, _exchange(y, held, 1 - np.einsum("ij,ij->i", held @ y, held)))
        if gain <= c * (1 + 1e-10):
            break
        chosen[inside[at]], vectors[inside[at]] = i, v
        swaps += 1
    return _result(q, "dominant", k, chosen, swaps)


def volume_removal(df: DataFrame, k: int, **_) -> DataFrame:
    """Removes the column of least leverage until k are left, thousands a pass and still one after another.

    Leverages only grow while columns go, so those of the pass are lower bounds. The least HELD_DOUBLES / m of
    them come to the driver and go from a heap, for as long as the least one, brought up to date, is below all that
    the pass left behind. The survivors are then written, and the table before is removed.
    """
    rest, m, n = _prepared(df)
    _checked(m, n, k)
    spark, left, before = df.sparkSession, n - k, None
    held = max(2, HELD_DOUBLES // m)
    while left:
        y = np.linalg.inv(gram_matrix(rest))
        least = rest.select("col_id", "vec", F.round(quadratic(y * n), 9).alias("s")).orderBy("s", "col_id").limit(held).toArrow()
        x = _rows(least.column("vec").combine_chunks())
        heap = list(zip(least.column("s").to_pylist(), least.column("col_id").to_pylist(), range(len(x)), strict=True))
        behind = heap.pop()[:2] if len(heap) == held else (math.inf, 0)
        gone: list[tuple[int]] = []
        while heap and len(gone) < left:
            _stale, i, p = heapq.heappop(heap)
            u = y @ x[p]
            own = float(x[p] @ u)
            now = (round(own * n, 9), i)
            if heap and heap[0][:2] < now:
                heapq.heappush(heap, (*now, p))
            elif gone and now >= behind:
                break
            else:
                y = y + np.outer(u, u) / (1 - own)
                gone.append((i,))
        left -= len(gone)
        path = shared_dir(spark, "survivors")
        rest.join(F.broadcast(spark.createDataFrame(gone, "col_id bigint")), "col_id", "left_anti").write.parquet(path)  # at most `held` ids
        rest = spark.read.schema(rest.schema).parquet(path)
        if before:
            remove_dir(spark, before)
        before = path
    return _result(rest, "volume removal", k, [r["col_id"] for r in rest.select("col_id").orderBy("col_id").collect()])


def dual_set(df: DataFrame, k: int, **_) -> DataFrame:
    """One pick for each of k rounds. Columns without weight share the upper barrier's term; those with weight are scored on the driver."""
    q, m, n = _prepared(df)
    _checked(m, n, k)
    if k <= m:
        raise ValueError("dual set needs k > m")
    if k == n:
        return _result(q, "dual set", k, [r["col_id"] for r in q.select("col_id").orderBy("col_id").collect()])
    step_u = (math.sqrt(n) + math.sqrt(k)) / (math.sqrt(k) - math.sqrt(m))
    lower, upper = -math.sqrt(k * m), step_u * math.sqrt(k * n)
    a, weights, vectors = np.zeros((m, m)), {}, {}
    for _round in range(k):
        values = np.linalg.eigvalsh(a)
        g = np.linalg.inv(a - (lower + 1) * np.eye(m))
        scale = (1 / (values - lower - 1)).sum() - (1 / (values - lower)).sum()
        form = g @ g / scale - g
        s = np.array([0.0, *weights.values()])
        h, other = 1 / (upper + step_u - s), n - len(weights)
        count = np.array([other, *[1] * len(weights)])
        high = h + h**2 / ((count / (upper - s)).sum() - (count * h).sum())
        i, v, ratio = _pick(_outside(q, list(weights)), _batched(form / high[0]))
        scored = [((ratio - 1) * high[0], i, v, high[0])]
        scored += [(float(vectors[c] @ form @ vectors[c]) - high[p], c, vectors[c], high[p]) for p, c in enumerate(weights, 1)]
        top = max(x[0] for x in scored)
        gain, i, v, cost = min((x for x in scored if x[0] >= top - 1e-9 * high[0]), key=lambda x: x[1])
        weight = 2 / (gain + 2 * cost)
        weights[i], vectors[i] = weights.get(i, 0.0) + weight, v
        a += weight * np.outer(v, v)
        lower, upper = lower + 1, upper + step_u
    support = sorted(weights)
    rest = _outside(q, support).select("col_id").orderBy("col_id").limit(k - len(support))
    return _result(q, "dual set", k, support + [r["col_id"] for r in rest.collect()])


def rect_maxvol(df: DataFrame, k: int, c: float = 1.0, **_) -> DataFrame:
    """m pivots, exchanges within the square, then the largest leverage until there are k.

    In a square every removal leaves no volume, so the gain of a pair is the squared coefficient of the new column
    on the old one: the best pair is one pick over the columns' largest coefficients.
    """
    if c < 1:
        raise ValueError("c must be at least 1")
    q, m, n = _prepared(df)
    _checked(m, n, k)
    if k == n:
        return _result(q, "rect-maxvol", k, [r["col_id"] for r in q.select("col_id").orderBy("col_id").collect()])
    left, chosen, vectors = np.eye(m), [], []
    for _step in range(m):
        i, v, _s = _pick(_outside(q, chosen), _batched(left * n))
        r = left @ v
        left = left - np.outer(r, r) / float(r @ r)
        chosen.append(i)
        vectors.append(v)
    cap, swaps = _swap_cap(m, m, c), 0
    while swaps < cap:
        inside = sorted(range(m), key=lambda p: chosen[p])
        held = np.array([vectors[p] for p in inside])
        solve = np.linalg.inv(held.T)
        i, v, gain, at = _best_exchange(q, chosen, _exchange(solve.T @ solve, held, np.zeros(m)))
        if gain <= c * (1 + 1e-10):
            break
        chosen[inside[at]], vectors[inside[at]] = i, v
        swaps += 1
    x = np.array(vectors).T
    return _result(q, "rect-maxvol", k, _grown(q, chosen, np.linalg.inv(x @ x.T), k, _batched)[0])


_FORMS: dict[str, Callable[..., DataFrame]] = {
    "random columns": random_columns,
    "leverage scores": leverage_scores,
    "forward iterative volume sampling": forward_volume,
    "frobenius selection": frobenius_selection,
    "volume add-remove": volume_add_remove,
    "dominant": dominant,
    "volume removal": volume_removal,
    "greedy volume": greedy_volume,
    "dual set": dual_set,
    "rect-maxvol": rect_maxvol,
}


def distributed_selector(name: str) -> Callable[..., DataFrame]:
    if name not in _FORMS:
        raise ValueError(f"{name!r} has no distributed form; those with one are {', '.join(sorted(_FORMS))}: use one of them or a sample")
    return _FORMS[name]
