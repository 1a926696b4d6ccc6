"""The registered queries and their oracles, over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsieve.functions.bounds import bounds_grid, orthonormal_curve
from colsieve.functions.linalg import dot, gram_relational, leverage, pinv_norms
from colsieve.functions.rng import uniform, uniform_sql
from colsieve.operators import distributed
from colsieve.operators.registry import gather, pad_selection, register_sql, secular_eigs, select_subset
from colsieve.plans import grid, metrics, prep, stats, tt
from colsieve.session import shared_dir, ship_package
from colsieve.sources import files, generators

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- matrices -------------------------------------------------------------------------------------


def embeddings_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column for each embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("col_id"), F.col("embedding").cast("array<double>").alias("vec"))


ORDER_FEATURES = "sum(l_quantity) AS qty, avg(l_discount) AS disc, count(*) AS cnt"


def orders_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: total quantity, mean discount, number of lines; y is the total price."""
    agg = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("col_id")).agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.count(F.lit(1)).cast("double").alias("cnt"), F.sum("l_extendedprice").alias("y"))
    return agg.select("col_id", F.array("qty", F.col("disc") * 10, "cnt").alias("vec"), "y")


ORDERS_SQL = "SELECT l_orderkey AS col_id, sum(l_quantity) AS x0, 10 * avg(l_discount) AS x1, CAST(count(*) AS DOUBLE) AS x2, sum(l_extendedprice) AS y FROM lineitem GROUP BY l_orderkey"


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, v1, v2, w): unordered pairs of supplier's and customer's nation, weighted by their lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = (
        li.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), li.l_orderkey == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.least("c_nationkey", "s_nationkey").alias("v1"), F.greatest("c_nationkey", "s_nationkey").alias("v2"))
        .filter("v1 <> v2")
    )
    return pairs.groupBy("v1", "v2").agg(F.count(F.lit(1)).cast("double").alias("w")).select((F.col("v1") * 25 + F.col("v2")).cast("bigint").alias("edge_id"), "v1", "v2", "w")


NATION_SQL = """
    SELECT CAST(v1 * 25 + v2 AS BIGINT) AS edge_id, v1, v2, CAST(count(*) AS DOUBLE) AS w
    FROM (SELECT least(c_nationkey, s_nationkey) AS v1, greatest(c_nationkey, s_nationkey) AS v2
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
    WHERE v1 <> v2 GROUP BY v1, v2
"""


def nation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 x edges: orthonormal rows of the weighted incidence matrix."""
    return generators.grounded(generators.incidence(nation_edges(spark, sf_dir), 25, F.col("w")))


CUSTOMER_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


#: Most levels of a category that become indicators.
MAX_LEVELS = 1_000


def customer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    levels = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(MAX_LEVELS + 1).collect()]
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels of c_mktsegment")
    return prep.features(c, "c_custkey", "c_mktsegment", levels, ["c_acctbal"])


def small_matrix(spark: SparkSession) -> DataFrame:
    """The fixed 3 x 5 example."""
    x = [[2, 1, 4, -3, 7], [5, 0, 1, 6, 2], [1, 8, -3, 2, 9]]
    return spark.createDataFrame([(j, [float(r[j]) for r in x]) for j in range(5)], "col_id bigint, vec array<double>")


# --- queries --------------------------------------------------------------------------------------

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


#: The published bounds written out by hand, apart from the expressions that the query uses: (selector, frobenius, spectral).
BOUNDS_SQL = """
    WITH s AS (SELECT CAST(p_size AS DOUBLE) AS m, CAST(p_size + 40 AS DOUBLE) AS n, CAST(p_size + p_partkey % 41 AS DOUBLE) AS k FROM part GROUP BY ALL),
    h AS (SELECT *, (k - m + 1) / (n - m + 1) AS kept, sqrt((k - 1) * m + 1) AS alpha, m * (n - k) / (k - m + 1) AS late, m * (n - m) AS early,
                 sqrt(n) + sqrt(k + 1) AS wide, sqrt((k + 1) * (n - m)) - sqrt(m * greatest(n - k - 1, 0)) AS gap FROM s),
    f AS (SELECT m, n, k, unnest([
        {'s': 'random columns', 'f': 0.0, 'p': 0.0},
        {'s': 'leverage scores', 'f': 0.0, 'p': 0.0},
        {'s': 'forward iterative volume sampling', 'f': 0.0, 'p': 0.0},
        {'s': 'reverse iterative volume sampling', 'f': 0.0, 'p': 0.0},
        {'s': 'volume removal', 'f': 0.0, 'p': 0.0},
        {'s': 'derandomized volume', 'f': 0.0, 'p': 0.0},
        {'s': 'frobenius removal', 'f': kept, 'p': kept / m},
        {'s': 'spectral removal', 'f': kept / m, 'p': 1 / (1 + late)},
        {'s': 'frobenius selection', 'f': k / m / (n - m + 1), 'p': k / (m * m) / (n - m + 1)},
        {'s': 'spectral selection', 'f': CASE WHEN m > 1 THEN m / n * ((k - alpha) / (alpha - 1)) ** 2 ELSE k / n END, 'p': CASE WHEN m > 1 THEN m / n * ((k - alpha) / (alpha - 1)) ** 2 ELSE k / n END},
        {'s': 'dual set', 'f': CASE WHEN k > m THEN ((sqrt(k + 1) - sqrt(m)) / wide) ** 2 END, 'p': CASE WHEN k > m THEN ((sqrt(k + 1) - sqrt(m)) / wide) ** 2 END},
        {'s': 'dominant', 'f': m / (m + late), 'p': 1 / (1 + late)},
        {'s': 'volume add-remove', 'f': m / (m + late), 'p': 1 / (1 + late)},
        {'s': 'rect-maxvol', 'f': 1 / (1 + n - m), 'p': 1 / (1 + early)},
        {'s': 'interlacing families', 'f': CASE WHEN k < n THEN (gap / n) ** 2 ELSE 1 END, 'p': CASE WHEN k < n THEN (gap / n) ** 2 ELSE 1 END}]) AS r FROM h)
    SELECT r.s AS selector, 'frobenius' AS norm, CAST(m AS BIGINT) AS m, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(CAST(r.f AS DOUBLE), 9) AS bound FROM f
    UNION ALL SELECT r.s, 'spectral', CAST(m AS BIGINT), CAST(n AS BIGINT), CAST(k AS BIGINT), round(CAST(r.p AS DOUBLE), 9) FROM f
"""


@query("bounds_grid", BOUNDS_SQL)
def bounds_grid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("m"), (F.col("p_size") + 40).cast("bigint").alias("n"), (F.col("p_size") + F.col("p_partkey") % 41).cast("bigint").alias("k")).distinct()
    return bounds_grid(spark, sizes).withColumn("bound", F.round("bound", 9))


@query("orthonormal_curve", "SELECT CAST(r AS BIGINT) AS k, round(sqrt((r - 9.0) / (10 * 91.0)), 9) AS frobenius, round(sqrt(1 / (1 + 10 * (100.0 - r) / (r - 9))), 9) AS spectral FROM range(10, 101) AS t(r)")
def orthonormal_curve_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ks = spark.range(10, 101).select(F.lit(10).alias("m"), F.lit(100).alias("n"), F.col("id").alias("k"))
    return ks.select("k", F.round(orthonormal_curve("frobenius"), 9).alias("frobenius"), F.round(orthonormal_curve("spectral"), 9).alias("spectral"))


@query("gram", f"WITH o AS ({ORDERS_SQL}), f AS (SELECT col_id, unnest([0, 1, 2]) AS i, unnest([x0, x1, x2]) AS a FROM o) SELECT CAST(p.i AS INTEGER) AS i, CAST(q.i AS INTEGER) AS j, round(sum(p.a * q.a), 4) AS v FROM f p JOIN f q ON p.col_id = q.col_id GROUP BY 1, 2")
def gram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_relational(orders_matrix(spark, sf_dir)).withColumn("v", F.round("v", 4))


#: Leverage of three features by Gram-Schmidt, in SQL.
LEVERAGE_SQL = f"""
    WITH o AS MATERIALIZED ({ORDERS_SQL}), n0 AS (SELECT sqrt(sum(x0 * x0)) AS s FROM o),
    q0 AS MATERIALIZED (SELECT col_id, x0 / s AS a, x1, x2, y FROM o, n0),
    p1 AS (SELECT sum(a * x1) AS r1, sum(a * x2) AS r2 FROM q0),
    t1 AS MATERIALIZED (SELECT col_id, a, x1 - a * r1 AS b, x2 - a * r2 AS x2 FROM q0, p1), n1 AS (SELECT sqrt(sum(b * b)) AS s FROM t1),
    q1 AS MATERIALIZED (SELECT col_id, a, b / s AS b, x2 FROM t1, n1), p2 AS (SELECT sum(b * x2) AS r FROM q1),
    t2 AS MATERIALIZED (SELECT col_id, a, b, x2 - b * r AS c FROM q1, p2), n2 AS (SELECT sqrt(sum(c * c)) AS s FROM t2),
    lev AS (SELECT col_id, a * a + b * b + c * c / (s * s) AS w FROM t2, n2)
"""


@query("whiten_leverage", LEVERAGE_SQL + " SELECT col_id, round(w, 8) AS w FROM lev")
def whiten_leverage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leverage(orders_matrix(spark, sf_dir)).select("col_id", F.round("w", 8).alias("w"))


@query("leverage_scores_topk", LEVERAGE_SQL + " SELECT col_id FROM lev ORDER BY round(w, 12) DESC, col_id LIMIT 20")
def leverage_topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leverage(orders_matrix(spark, sf_dir)).orderBy(F.round("w", 12).desc(), "col_id").limit(20).select("col_id")


@query("leverage_scores_sample", LEVERAGE_SQL + f" SELECT col_id FROM lev ORDER BY -ln({uniform_sql(42, 0, 0, 'col_id')}) / w, col_id LIMIT 20")
def leverage_sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_subset(orders_matrix(spark, sf_dir), 20, "leverage scores", path="distributed", seed=42).select("col_id")


@query("random_columns", f"SELECT vec_id AS col_id FROM embeddings ORDER BY {uniform_sql(42, 0, 0, 'vec_id')}, vec_id LIMIT 80")
def random_columns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_subset(embeddings_matrix(spark, sf_dir), 80, "random columns", path="distributed", seed=42).select("col_id")


@query("pinv_norms", f"WITH o AS ({ORDERS_SQL}), g AS (SELECT sum(x0 * x0) AS a, sum(x0 * x2) AS b, sum(x2 * x2) AS d FROM o), t AS (SELECT a + d AS tr, a * d - b * b AS det FROM g) SELECT 'frobenius' AS norm, round(sqrt(tr / det), 8) AS value FROM t UNION ALL SELECT 'spectral', round(1 / sqrt(2 * det / (tr + sqrt(tr * tr - 4 * det))), 8) FROM t")
def pinv_norms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = orders_matrix(spark, sf_dir).select("col_id", F.array(F.col("vec")[0], F.col("vec")[2]).alias("vec"))
    return spark.createDataFrame([(n, round(v, 8)) for n, v in pinv_norms(two).items()], "norm string, value double")


def _selection(name: str, matrix: Callable[[SparkSession, str], DataFrame], k: int, columns: tuple[str, ...] = ("col_id",), **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select_subset(matrix(spark, sf_dir), k, name, **params).select(*columns)

    return run


for _key, _name, _matrix, _k, _params in [
    ("volume_removal", "volume removal", nation_matrix, 40, {}),
    ("frobenius_removal", "frobenius removal", nation_matrix, 40, {}),
    ("spectral_removal", "spectral removal", nation_matrix, 40, {}),
    ("frobenius_selection", "frobenius selection", embeddings_matrix, 80, {}),
    ("spectral_selection", "spectral selection", nation_matrix, 40, {}),
    ("dual_set", "dual set", embeddings_matrix, 96, {}),
    ("rect_maxvol", "rect-maxvol", embeddings_matrix, 80, {"c": 1.0}),
    ("derandomized_volume", "derandomized volume", nation_matrix, 40, {}),
    ("forward_volume", "forward iterative volume sampling", nation_matrix, 40, {"seed": 42}),
    ("reverse_volume", "reverse iterative volume sampling", nation_matrix, 40, {"seed": 42}),
]:
    query(_key)(_selection(_name, _matrix, _k, **_params))
for _init in ("cpqr", "greedy", "advanced"):
    for _key, _name in (("dominant", "dominant"), ("volume_add_remove", "volume add-remove")):
        query(f"{_key}_{_init}")(_selection(_name, nation_matrix, 40, ("col_id", "swap_count"), c=1.0, initialization=_init))


@query("interlacing_families")
def interlacing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_subset(small_matrix(spark), 4, "interlacing families").select("col_id")


#: Three pivots of a 3-row matrix: each the largest residual, by projecting the pivots out one after another.
PIVOT_SQL = LEVERAGE_SQL.replace("lev AS (", "w0 AS MATERIALIZED (SELECT col_id, a, b, c / s AS c FROM t2, n2), lev AS (") + """,
    s1 AS MATERIALIZED (SELECT *, a * a + b * b + c * c AS r FROM w0), k1 AS (SELECT * FROM s1 ORDER BY round(r, 9) DESC, col_id LIMIT 1),
    w1 AS MATERIALIZED (SELECT w.col_id, w.a - k.a * d / k.r AS a, w.b - k.b * d / k.r AS b, w.c - k.c * d / k.r AS c FROM (SELECT w0.*, w0.a * k1.a + w0.b * k1.b + w0.c * k1.c AS d FROM w0, k1) w, k1 k WHERE w.col_id <> k.col_id),
    s2 AS MATERIALIZED (SELECT *, a * a + b * b + c * c AS r FROM w1), k2 AS (SELECT * FROM s2 ORDER BY round(r, 9) DESC, col_id LIMIT 1),
    w2 AS MATERIALIZED (SELECT w.col_id, w.a - k.a * d / k.r AS a, w.b - k.b * d / k.r AS b, w.c - k.c * d / k.r AS c FROM (SELECT w1.*, w1.a * k2.a + w1.b * k2.b + w1.c * k2.c AS d FROM w1, k2) w, k2 k WHERE w.col_id <> k.col_id),
    k3 AS (SELECT col_id FROM w2 ORDER BY round(a * a + b * b + c * c, 9) DESC, col_id LIMIT 1)
    SELECT 0 AS rank, col_id FROM k1 UNION ALL SELECT 1, col_id FROM k2 UNION ALL SELECT 2, col_id FROM k3
"""


@query("cpqr_start", PIVOT_SQL)
def cpqr_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributed.cpqr_start(orders_matrix(spark, sf_dir)).select("rank", "col_id")


# Selections on matrices of three rows as SQL, one common table for each step. Every step reads w0 (col_id, a, b, c), the whitened
# columns, and the ids chosen so far; y is the inverse of the chosen columns' Gram.


def _inverse_sql(step: str, chosen: str) -> str:
    return f"""
        g_{step} AS MATERIALIZED (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc FROM w0 WHERE col_id IN (SELECT col_id FROM {chosen})),
        d_{step} AS MATERIALIZED (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM g_{step}),
        y_{step} AS MATERIALIZED (SELECT (bb * cc - bc * bc) / det AS p, (ac * bc - ab * cc) / det AS q, (ab * bc - ac * bb) / det AS r, (aa * cc - ac * ac) / det AS s, (ab * ac - aa * bc) / det AS t, (aa * bb - ab * ab) / det AS u FROM d_{step}),
        z_{step} AS MATERIALIZED (SELECT col_id, p * a + q * b + r * c AS za, q * a + s * b + t * c AS zb, r * a + t * b + u * c AS zc, w0.a, w0.b, w0.c FROM w0, y_{step}),
        l_{step} AS MATERIALIZED (SELECT col_id, za * a + zb * b + zc * c AS l, za * za + zb * zb + zc * zc AS l2, za, zb, zc, a, b, c FROM z_{step})"""


def _add_sql(step: str, chosen: str, into: str, score: str) -> str:
    """The unchosen column with the largest score joins."""
    return _inverse_sql(step, chosen) + f""",
        {into} AS MATERIALIZED (SELECT col_id FROM {chosen} UNION ALL (SELECT col_id FROM l_{step} WHERE col_id NOT IN (SELECT col_id FROM {chosen}) ORDER BY round({score}, 9) DESC, col_id LIMIT 1))"""


def _drop_sql(step: str, chosen: str, into: str, score: str) -> str:
    """The chosen column with the least score leaves."""
    return _inverse_sql(step, chosen) + f""",
        {into} AS MATERIALIZED (SELECT col_id FROM {chosen} WHERE col_id <> (SELECT col_id FROM l_{step} WHERE col_id IN (SELECT col_id FROM {chosen}) ORDER BY round({score}, 9), col_id LIMIT 1))"""


def _greedy_sql(whitened: str, k: int) -> str:
    """Common tables up to c_k: three pivots, then the largest leverages."""
    first = f"{whitened}, c_3 AS MATERIALIZED (SELECT col_id FROM k1 UNION ALL SELECT col_id FROM k2 UNION ALL SELECT col_id FROM k3)"
    return ",".join([first, *(_add_sql(f"g{n}", f"c_{n}", f"c_{n + 1}", "l") for n in range(3, k))])


def _lowest_sql(whitened: str, k: int) -> str:
    """Common tables up to c_k: three pivots, then the lowest ids."""
    return f"""{_greedy_sql(whitened, 3)},
        c_{k} AS MATERIALIZED (SELECT col_id FROM c_3 UNION ALL (SELECT col_id FROM w0 WHERE col_id NOT IN (SELECT col_id FROM c_3) ORDER BY col_id LIMIT {k - 3}))"""


def _exchange_sql(whitened: str, k: int, rounds: int, pair: str, start: Callable[[str, int], str] = _greedy_sql) -> str:
    """k columns and the exchanges that grew the volume; a round that doesn't grow it changes nothing, nor do those that follow."""
    parts, at = [start(whitened, k), f"n_0 AS (SELECT 0 AS swaps), e_0 AS MATERIALIZED (SELECT col_id FROM c_{k})"], "e_0"
    for t in range(rounds):
        parts.append(_inverse_sql(f"x{t}", at))
        parts.append(pair.format(t=t, at=at))
        parts.append(f"n_{t + 1} AS (SELECT swaps + (SELECT count(*) FROM b_{t}) AS swaps FROM n_{t})")
        at = f"e_{t + 1}"
        parts.append(f"{at} AS MATERIALIZED (SELECT col_id FROM e_{t} WHERE col_id NOT IN (SELECT o FROM b_{t}) UNION ALL SELECT i FROM b_{t})")
    return ",".join(parts) + f" SELECT col_id, CAST(swaps AS BIGINT) AS swap_count FROM {at}, n_{rounds}"


#: The exchange (i in, o out) of the largest gain in volume, if it is one.
_BEST_PAIR = """
    b_{t} AS MATERIALIZED (SELECT i, o FROM (
        SELECT x.col_id AS i, h.col_id AS o, (1 + x.l) * (1 - h.l) + pow(x.a * h.za + x.b * h.zb + x.c * h.zc, 2) AS gain
        FROM l_x{t} x, l_x{t} h WHERE h.col_id IN (SELECT col_id FROM {at}) AND x.col_id NOT IN (SELECT col_id FROM {at})
        ORDER BY round(gain, 9) DESC, o, i LIMIT 1) WHERE gain > 1 + 1e-10)"""
#: The column of the largest leverage comes in, then of all that are there the one of the least leverage goes.
_ADD_THEN_DROP = """
    i_{t} AS MATERIALIZED (SELECT * FROM l_x{t} WHERE col_id NOT IN (SELECT col_id FROM {at}) ORDER BY round(l, 9) DESC, col_id LIMIT 1),
    b_{t} AS MATERIALIZED (SELECT i, o FROM (
        SELECT x.col_id AS i, h.col_id AS o, h.l - pow(x.a * h.za + x.b * h.zb + x.c * h.zc, 2) / (1 + x.l) AS loss, x.l AS l
        FROM i_{t} x, l_x{t} h WHERE h.col_id IN (SELECT col_id FROM {at}) ORDER BY round(loss, 9), o LIMIT 1) WHERE (1 + l) * (1 - loss) > 1 + 1e-10)"""

_PIVOTS = PIVOT_SQL[: PIVOT_SQL.rindex("SELECT 0 AS rank")].rstrip()


@query("greedy_start_distributed", _greedy_sql(_PIVOTS, 8) + " SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS rank, col_id FROM (SELECT *, row_number() OVER () AS r FROM c_8 ORDER BY r)")
def greedy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributed.greedy_volume(orders_matrix(spark, sf_dir), 8).select("rank", "col_id")


@query("volume_add_remove_distributed", _exchange_sql(_PIVOTS, 6, 8, _ADD_THEN_DROP))
def add_remove_distributed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_subset(orders_matrix(spark, sf_dir), 6, "volume add-remove", path="distributed").select("col_id", "swap_count")


#: Least (1 + squared length in the chosen basis) / squared residual: the first is the longest, then one and two coefficients are solved for.
_FROBENIUS_PIVOTS = """,
    f1 AS MATERIALIZED (SELECT * FROM s1 ORDER BY round(1 / r, 9), col_id LIMIT 1),
    f2 AS MATERIALIZED (SELECT s.col_id, s.a, s.b, s.c FROM (SELECT w0.*, w0.a * f1.a + w0.b * f1.b + w0.c * f1.c AS d, f1.r AS f, w0.a * w0.a + w0.b * w0.b + w0.c * w0.c AS n FROM w0, f1 WHERE w0.col_id <> f1.col_id) s
        WHERE n - d * d / f > 1e-14 ORDER BY round((1 + pow(d / f, 2)) / (n - d * d / f), 9), col_id LIMIT 1),
    f3 AS MATERIALIZED (SELECT col_id FROM (
        SELECT col_id, n, d, e, (d * h - e * o) / (f * h - o * o) AS u, (e * f - d * o) / (f * h - o * o) AS v FROM (
            SELECT w0.col_id, w0.a * w0.a + w0.b * w0.b + w0.c * w0.c AS n, w0.a * f1.a + w0.b * f1.b + w0.c * f1.c AS d, w0.a * f2.a + w0.b * f2.b + w0.c * f2.c AS e,
                   f1.r AS f, f2.a * f2.a + f2.b * f2.b + f2.c * f2.c AS h, f1.a * f2.a + f1.b * f2.b + f1.c * f2.c AS o
            FROM w0, f1, f2 WHERE w0.col_id NOT IN (f1.col_id, f2.col_id)))
        WHERE n - u * d - v * e > 1e-14 ORDER BY round((1 + u * u + v * v) / (n - u * d - v * e), 9), col_id LIMIT 1),
    c_3 AS MATERIALIZED (SELECT col_id FROM f1 UNION ALL SELECT col_id FROM f2 UNION ALL SELECT col_id FROM f3)"""


def _frobenius_sql(whitened: str, k: int) -> str:
    return ",".join([whitened + _FROBENIUS_PIVOTS, *(_add_sql(f"g{n}", f"c_{n}", f"c_{n + 1}", "l2 / (1 + l)") for n in range(3, k))]) + f" SELECT col_id FROM c_{k}"


@query("frobenius_selection_distributed", _frobenius_sql(_PIVOTS, 6))
def frobenius_distributed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_subset(orders_matrix(spark, sf_dir), 6, "frobenius selection", path="distributed").select("col_id")


def profile_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation of all customers: their number, their mean balance and the number of their market segment BUILDING."""
    of = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("col_id"))
    agg = of.agg(F.count(F.lit(1)).cast("double").alias("a"), (F.avg("c_acctbal") / 100).alias("b"), F.sum((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("c"))
    return agg.select("col_id", F.array("a", "b", "c").alias("vec"))


_PROFILE_SQL = "SELECT CAST(c_nationkey AS BIGINT) AS col_id, CAST(count(*) AS DOUBLE) AS x0, avg(c_acctbal) / 100 AS x1, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1e0 ELSE 0e0 END) AS x2, 0e0 AS y FROM customer GROUP BY c_nationkey"
_PROFILE_PIVOTS = _PIVOTS.replace(ORDERS_SQL, _PROFILE_SQL)
_RAW = f"WITH w0 AS MATERIALIZED (SELECT col_id, x0 AS a, x1 AS b, x2 AS c FROM ({_PROFILE_SQL})), c_25 AS (SELECT col_id FROM w0)"


def _removal_sql(whitened: str, k: int, score: str) -> str:
    return ",".join([whitened, *(_drop_sql(f"r{n}", f"c_{n}", f"c_{n - 1}", score) for n in range(25, k, -1))]) + f" SELECT col_id FROM c_{k}"


_ALL = ", c_25 AS (SELECT col_id FROM w0)"
for _key, _name, _k, _sql in [
    ("volume_removal_profile", "volume removal", 15, _removal_sql(_RAW, 15, "l")),
    ("frobenius_removal_profile", "frobenius removal", 15, _removal_sql(_RAW, 15, "l2 / (1 - l)")),
    ("spectral_removal_profile", "spectral removal", 15, _removal_sql(_PROFILE_PIVOTS + _ALL, 15, "l2 / (1 - l)")),
    ("frobenius_selection_profile", "frobenius selection", 7, _frobenius_sql(_PROFILE_PIVOTS, 7)),
]:
    query(_key, _sql)(_selection(_name, profile_matrix, _k))
for _key, _name, _pair in (("dominant_profile", "dominant", _BEST_PAIR), ("volume_add_remove_profile", "volume add-remove", _ADD_THEN_DROP)):
    for _init, _start, _k in (("greedy", _greedy_sql, 5), ("cpqr", _lowest_sql, 9)):
        query(f"{_key}_{_init}", _exchange_sql(_PROFILE_PIVOTS, _k, 10, _pair, _start))(_selection(_name, profile_matrix, _k, ("col_id", "swap_count"), c=1.0, initialization=_init))
query("rect_maxvol_profile", ",".join([_exchange_sql(_PROFILE_PIVOTS, 3, 8, _BEST_PAIR).rsplit(" SELECT col_id, CAST(swaps", 1)[0] + ", c_3r AS (SELECT col_id FROM e_8)", _add_sql("m3", "c_3r", "c_4r", "l"), _add_sql("m4", "c_4r", "c_5r", "l")]) + " SELECT col_id FROM c_5r")(
    _selection("rect-maxvol", profile_matrix, 5, c=1.0)
)


@query("select_subset_sql")
def select_subset_sql_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function: leverage sampling, which needs no more than one pass in its task."""
    register_sql(spark)
    customer_matrix(spark, sf_dir).select("col_id", "vec").createOrReplaceTempView("customer_columns")
    return spark.sql("SELECT rank, col_id FROM select_subset(TABLE(customer_columns), 12, 'frobenius selection')")


SECULAR_CASES = [("distinct", [1.0, 2.0, 4.0], [0.5, 1.0, 2.0]), ("zero_v", [1.0, 2.0, 3.0], [0.0, 1.0, 0.0]), ("repeated_d", [1.0, 1.0, 2.0], [1.0, 2.0, 1.0]), ("zero_d", [0.0, 0.0, 0.0], [1.0, 2.0, 2.0]), ("one", [3.0], [2.0]), ("ramp", [float(i) for i in range(1, 21)], [1 / (i + 1) for i in range(20)])]


#: By the inertia of diag(d) - x + v v^T: of its eigenvalues, as many are below x as there are d below x, less one where 1 + sum of v^2 / (d - x) isn't positive.
#: The eigenvalue with number idx is bisected between the least d and the largest plus the sum of v^2; d equal to x count as just above.
SECULAR_SQL = """WITH RECURSIVE cases(name, d, v) AS (VALUES {rows}),
s(name, idx, step, d, v, lo, hi) AS (
  SELECT name, i, 0, d, v, list_min(d), list_max(d) + list_sum(list_transform(v, lambda e: e * e)) FROM cases, LATERAL (SELECT unnest(range(len(d))) AS i)
  UNION ALL
  SELECT name, idx, step + 1, d, v, CASE WHEN below <= idx THEN x ELSE lo END, CASE WHEN below <= idx THEN hi ELSE x END FROM (
    SELECT *, len(list_filter(d, lambda e: e < x)) - CASE WHEN 1 + list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN v[i] = 0 THEN 0 WHEN d[i] = x THEN 1e300 ELSE v[i] * v[i] / (d[i] - x) END)) > 0 THEN 0 ELSE 1 END AS below
    FROM (SELECT *, (lo + hi) / 2 AS x FROM s WHERE step < 80)))
SELECT name AS "case", CAST(idx AS INTEGER) AS idx, round((lo + hi) / 2, 9) AS eig FROM s WHERE step = 80""".format(
    rows=", ".join(f"('{name}', {d}::DOUBLE[], {v}::DOUBLE[])" for name, d, v in SECULAR_CASES)
)


@query("secular_eigs", SECULAR_SQL)
def secular_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    cases = spark.createDataFrame(SECULAR_CASES, "case string, d array<double>, v array<double>")
    return cases.select("case", F.posexplode(secular_eigs()("d", "v")).alias("idx", "eig")).withColumn("eig", F.round("eig", 9))


@query("gen_gaussian", "SELECT j AS col_id, CAST(i AS INTEGER) AS i, round(sqrt(-2 * ln(" + uniform_sql(7, 0, 0, "(i || '|' || j || '|a')") + ")) * cos(2 * 3.141592653589793 * " + uniform_sql(7, 0, 0, "(i || '|' || j || '|b')") + "), 9) AS v FROM range(200) AS a(j), range(5) AS b(i)")
def gaussian_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.gaussian_matrix(spark, 5, 200, seed=7).select("col_id", F.posexplode("vec").alias("i", "v")).withColumn("v", F.round("v", 9))


@query("gen_zero", "SELECT range AS col_id, CAST(0 AS DOUBLE) AS total FROM range(50)")
def zero_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.zero_matrix(spark, 4, 50).select("col_id", dot(F.col("vec"), F.col("vec")).alias("total"))


def _off_identity(df: DataFrame) -> DataFrame:
    g = gram_relational(df)
    return g.select("i", "j", (F.round("v", 8) + 0.0).alias("v"))


@query("gen_orthonormal", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE) AS v FROM range(4) AS a(i), range(4) AS b(j)")
def orthonormal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gram of generated orthonormal rows."""
    return _off_identity(generators.orthonormal_matrix(spark, 4, 60, seed=3)).withColumn("v", F.when(F.abs("v") < 1e-7, 0.0).otherwise(F.col("v")))


@query("gen_sigma", "SELECT CAST(idx AS INTEGER) AS idx, CAST(s AS DOUBLE) AS s FROM (VALUES (0, 5), (1, 3), (2, 1)) AS t(idx, s)")
def sigma_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singular values of a generated matrix with given ones."""
    s = prep.singular_values(generators.sigma_matrix(spark, 3, 40, [5.0, 3.0, 1.0], seed=4))
    return spark.createDataFrame([(i, round(float(v), 8)) for i, v in enumerate(s)], "idx int, s double")


_PAIRS = "SELECT CAST(v1 AS INTEGER) AS v1, CAST(v2 AS INTEGER) AS v2, " + uniform_sql(11, 0, 0, "(v1 || '|' || v2)") + " AS u FROM range(13) AS a(v1), range(13) AS b(v2) WHERE v1 < v2 ORDER BY u, v1, v2 LIMIT 40"


@query("gen_weighted_edges", f"SELECT edge_id, v1, v2, round(1 - {uniform_sql(11, 100, 0, 'edge_id')}, 9) AS w FROM (SELECT row_number() OVER (ORDER BY u, v1, v2) - 1 AS edge_id, v1, v2 FROM ({_PAIRS}))")
def weighted_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.random_edges(spark, 13, 40, seed=11).withColumn("w", F.round(1 - uniform(11, 100, 0, F.col("edge_id")), 9))


def _incidence_sql(weight: str) -> str:
    return f"""
        WITH e AS (SELECT row_number() OVER (ORDER BY u, v1, v2) - 1 AS edge_id, v1, v2 FROM ({_PAIRS})), w AS (SELECT *, sqrt({weight}) AS s FROM e)
        SELECT CAST(i AS INTEGER) AS i, edge_id, round(CASE i WHEN v1 THEN s WHEN v2 THEN -s ELSE 0 END, 7) + 0.0 AS v FROM w, range(13) AS r(i)
    """


def _row_space(edges: DataFrame, q: DataFrame, weight: Column | None) -> DataFrame:
    """(i, edge_id, v): the incidence matrix of edges times the projector on the rows of q; it is the matrix itself where q spans its rows."""
    cells = generators.incidence(edges, 13, weight).select(F.col("col_id"), F.posexplode("vec").alias("i", "b"))
    rows = q.select("col_id", F.posexplode("vec").alias("j", "x"))
    image = cells.join(rows, "col_id").groupBy("i", "j").agg(F.sum(F.col("b") * F.col("x")).alias("w"))
    back = image.join(rows, "j").groupBy("i", F.col("col_id").alias("edge_id")).agg(F.sum(F.col("w") * F.col("x")).alias("v"))
    return back.select("i", "edge_id", (F.round("v", 7) + 0.0).alias("v"))


@query("gen_graph", _incidence_sql("1.0"))
def graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidence matrix that a generated graph's orthonormal rows give back."""
    return _row_space(generators.random_edges(spark, 13, 40, seed=11), generators.graph_incidence(spark, 12, 40, seed=11), None)


@query("gen_weighted_graph", _incidence_sql("1 - " + uniform_sql(11, 100, 0, "edge_id")))
def weighted_graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_space(generators.random_edges(spark, 13, 40, seed=11), generators.weighted_graph_incidence(spark, 12, 40, seed=11), 1 - uniform(11, 100, 0, F.col("edge_id")))


@query("nation_graph", NATION_SQL)
def nation_graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_edges(spark, sf_dir)


@query("one_hot_standardize", "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d FROM customer), l AS (SELECT DISTINCT c_mktsegment AS seg FROM customer ORDER BY 1 OFFSET 1), c AS (SELECT c_custkey AS col_id, [CASE WHEN c_mktsegment = seg THEN 1.0 ELSE 0.0 END FOR seg IN (SELECT list(seg ORDER BY seg) FROM l)] AS hot, (c_acctbal - m) / d AS z FROM customer, s) SELECT col_id, CAST(unnest(range(len(hot) + 2)) AS INTEGER) AS i, round(CAST(unnest(list_concat(hot, [z, 1.0])) AS DOUBLE), 6) AS v FROM c")
def one_hot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_matrix(spark, sf_dir).select("col_id", F.posexplode("vec").alias("i", "v")).withColumn("v", F.round("v", 6))


_CHOSEN = "col_id % 7 = 0"


@query("metrics_volume_ratio", f"WITH o AS ({ORDERS_SQL}), g AS (SELECT sum(x0*x0) AS a, sum(x0*x1) AS b, sum(x0*x2) AS c, sum(x1*x1) AS d, sum(x1*x2) AS e, sum(x2*x2) AS f FROM o), h AS (SELECT sum(x0*x0) AS a, sum(x0*x1) AS b, sum(x0*x2) AS c, sum(x1*x1) AS d, sum(x1*x2) AS e, sum(x2*x2) AS f FROM o WHERE {_CHOSEN}), p AS (SELECT a*(d*f-e*e)-b*(b*f-c*e)+c*(b*e-c*d) AS x FROM g), q AS (SELECT a*(d*f-e*e)-b*(b*f-c*e)+c*(b*e-c*d) AS y FROM h) SELECT round(sqrt(y / x), 6) AS volume_ratio FROM p, q")
def volume_ratio_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = orders_matrix(spark, sf_dir)
    m = metrics.selection_metrics(x, x.filter(_CHOSEN))
    return spark.createDataFrame([(round(m["volume_ratio"], 6),)], "volume_ratio double")


@query("metrics_regression_mse", f"WITH o AS ({ORDERS_SQL}), g AS (SELECT sum(x0*x0) AS a, sum(x0*x2) AS b, sum(x2*x2) AS d, sum(x0*y) AS p, sum(x2*y) AS q FROM o WHERE {_CHOSEN}), s AS (SELECT (d*p-b*q)/(a*d-b*b) AS u, (a*q-b*p)/(a*d-b*b) AS v FROM g) SELECT round(avg((u*x0+v*x2-y)*(u*x0+v*x2-y)) / 1e6, 3) AS regression_mse FROM o, s")
def regression_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = orders_matrix(spark, sf_dir).withColumn("vec", F.array(F.col("vec")[0], F.col("vec")[2]))
    m = metrics.selection_metrics(x, x.filter(_CHOSEN), "y")
    return spark.createDataFrame([(round(m["regression_mse"] / 1e6, 3),)], "regression_mse double")


@query("metrics_selection")
def metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quality metrics of a greedy selection of 80 embeddings."""
    x = embeddings_matrix(spark, sf_dir)
    m = metrics.selection_metrics(x, select_subset(x, 80, "frobenius selection"))
    return spark.createDataFrame([(k, None if np.isnan(v) else round(v, 6)) for k, v in m.items()], "metric string, value double")


GRID = {
    "scalar": "double",
    "experiments": [
        {"name": "gaussian", "matrix": {"type": "gaussian matrix", "rows": 8, "cols": 60, "seed": 42}, "trials": 3, "k_values_range": {"start": 10, "stop": 20, "step": 5}, "algorithms": [{"name": "spectral removal"}, {"name": "frobenius removal"}, {"name": "dominant", "c": 1, "initialization": "greedy"}, {"name": "volume add-remove", "c": 1, "initialization": "cpqr"}, {"name": "dual set"}]},
        {"name": "graph", "matrix": {"type": "weighted graph incidence matrix", "rows": 8, "cols": 30, "seed": 42}, "trials": 2, "k_values": [8, 12], "algorithms": [{"name": "spectral selection"}, {"name": "leverage scores", "seed": 1}, {"name": "derandomized volume"}]},
        {"name": "off", "enabled": False, "matrix": {"type": "zero matrix"}, "algorithms": [], "k_values": []},
    ],
}


@query("experiment_grid")
def grid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.run_grid(spark, GRID).drop("wall_time_ms")


def results_table(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """A deterministic results table from lineitem: algorithm, k, metrics, more."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("algorithm"), F.col("l_linenumber").cast("bigint").alias("k"), F.col("l_discount").alias("pinv_spectral_norm_ratio"), F.col("l_tax").alias("volume_ratio"), (F.col("l_suppkey") % 9 - 1).alias("swap_count"), *more)


RESULTS_SQL = "SELECT l_returnflag AS algorithm, CAST(l_linenumber AS BIGINT) AS k, l_discount AS pinv_spectral_norm_ratio, l_tax AS volume_ratio, l_suppkey % 9 - 1 AS swap_count FROM lineitem"


@query("grid_mean_std", f"WITH r AS ({RESULTS_SQL}) SELECT algorithm, k, round(avg(v), 8) AS mean, round(coalesce(stddev_samp(v), 0), 8) AS std FROM (SELECT algorithm, k, pinv_spectral_norm_ratio * pinv_spectral_norm_ratio AS v FROM r WHERE k BETWEEN 2 AND 6) GROUP BY algorithm, k")
def mean_std_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.mean_std(stats.in_range(results_table(spark, sf_dir), 2, 6), "pinv_spectral_norm_ratio")
    return out.select("algorithm", "k", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@query("grid_swap_quantiles", f"WITH r AS ({RESULTS_SQL}) SELECT algorithm, k, greatest(quantile_cont(swap_count, 0.25), 0.5) AS p25, CAST(quantile_cont(swap_count, 0.5) AS DOUBLE) AS median, CAST(quantile_cont(swap_count, 0.75) AS DOUBLE) AS p75 FROM r WHERE swap_count >= 0 GROUP BY algorithm, k")
def swap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.swap_quantiles(results_table(spark, sf_dir))


@query("grid_dispersion", f"WITH r AS ({RESULTS_SQL}), m AS (SELECT algorithm, k, median(volume_ratio) AS v FROM r WHERE k BETWEEN 2 AND 6 GROUP BY algorithm, k) SELECT k, round(CASE WHEN count(*) >= 2 AND avg(v) <> 0 THEN (max(v) - min(v)) / avg(v) END, 8) AS dispersion FROM m GROUP BY k")
def dispersion_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dispersion(results_table(spark, sf_dir), "volume_ratio", 2).withColumn("dispersion", F.round("dispersion", 8))


@query("grid_distribution", f"WITH r AS (SELECT algorithm, k, volume_ratio AS v FROM ({RESULTS_SQL}) WHERE k IN (1, 3, 5)), s AS (SELECT algorithm, k, min(v) AS lo, max(v) AS hi FROM r GROUP BY algorithm, k) SELECT algorithm, k, CAST(CASE WHEN hi > lo THEN least(9, floor((v - lo) / (hi - lo) * 10)) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM r JOIN s USING (algorithm, k) GROUP BY ALL")
def distribution_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(results_table(spark, sf_dir), "volume_ratio", [1, 3, 5])


@query("grid_distinct_k", "SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS k FROM lineitem")
def distinct_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_k(results_table(spark, sf_dir))


@query("grid_union", f"WITH r AS ({RESULTS_SQL}) SELECT algorithm, CASE algorithm WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS place, count(*) * 2 AS n FROM r GROUP BY algorithm")
def union_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results_table(spark, sf_dir)
    return stats.union_results([r, r], ["R", "N"]).groupBy("algorithm", "place").agg(F.count(F.lit(1)).alias("n"))


@query("export_results_csv", f"SELECT algorithm, k, CAST(coalesce(swap_count, -1) AS BIGINT) AS swap_count, count(*) AS n, round(sum(pinv_spectral_norm_ratio), 6) AS total FROM ({RESULTS_SQL}) GROUP BY ALL")
def export_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as CSV by experiment and algorithm, read again; an untracked swap count comes back as -1."""
    path = shared_dir(spark, "results-csv")
    files.export_csv(_full_results(spark, sf_dir), path)
    back = spark.read.option("header", True).schema(", ".join(f"{c} {'bigint' if c in ('k', 'swap_count') else 'double'}" for c in files.CSV_COLUMNS) + ", algorithm string").csv(path)
    return back.groupBy("algorithm", "k", "swap_count").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pinv_spectral_norm_ratio"), 6).alias("total"))


@query("experiment_index", "SELECT DISTINCT 'flag ' || l_linestatus AS experiment FROM lineitem")
def index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "results")
    files.write_results(_full_results(spark, sf_dir), path)
    return files.experiment_index(spark, path)


def _full_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """results_table with all columns of a grid's results, an experiment for each line status; swap counts of -1 are untracked."""
    r = results_table(spark, sf_dir, F.concat(F.lit("flag "), "l_linestatus").alias("experiment"))
    r = r.withColumn("swap_count", F.when(F.col("swap_count") >= 0, F.col("swap_count")))
    kinds = dict(c.split() for c in grid.RESULT_SCHEMA.split(", "))
    return r.select(*(c if c in r.columns else F.lit(0).cast(t).alias(c) for c, t in kinds.items()))


def _file(spark: SparkSession, sf_dir: str, kind: str, value: str, head: list[str]) -> str:
    """A text file of the given kind in the shared folder: the head's lines, then a line for each nation (25 of them, so one task writes it)."""
    path = shared_dir(spark, "file") + "." + kind
    lines = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("at"), F.expr(value).alias("value"))
    top = spark.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "at int, value string")
    top.unionByName(lines).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


_NATION_LINE = "concat_ws(',', n_nationkey, n_regionkey, n_name, length(n_name))"
_AT = "row_number() OVER (ORDER BY n_nationkey) - 1"


@query("read_csv_matrix", f"SELECT col_id, CAST(unnest(range(3)) AS INTEGER) AS i, CAST(unnest([n_nationkey, n_regionkey, length(n_name)]) AS DOUBLE) AS v FROM (SELECT *, {_AT} AS col_id FROM nation)")
def csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of a CSV file, by its extension: comments and blank lines go, tokens that aren't numbers drop out."""
    x = files.read_matrix(spark, _file(spark, sf_dir, "csv", _NATION_LINE, ["# key, region, name, length", ""]))
    return x.select("col_id", F.posexplode("vec").alias("i", "v"))


@query("read_arff_matrix", f"SELECT col_id, CAST(unnest(range(4)) AS INTEGER) AS i, CAST(unnest([n_nationkey, n_regionkey, 0, length(n_name)]) AS DOUBLE) AS v FROM (SELECT *, {_AT} AS col_id FROM nation)")
def arff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of an ARFF file, by its extension: what isn't a number counts as 0."""
    x = files.read_matrix(spark, _file(spark, sf_dir, "arff", _NATION_LINE, ["% nations", "@relation nations", "@attribute name string", "@DATA"]))
    return x.select("col_id", F.posexplode("vec").alias("i", "v"))


@query("matrix_from_file", f"SELECT col_id, CAST(unnest(range(3)) AS INTEGER) AS i, CAST(unnest([n_nationkey, n_regionkey, length(n_name)]) AS DOUBLE) AS v, n_regionkey + 0.5e0 AS y FROM (SELECT *, {_AT} AS col_id FROM nation)")
def matrix_file_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator over a file and the target of another one."""
    path, target = _file(spark, sf_dir, "data", _NATION_LINE, []), _file(spark, sf_dir, "csv", "cast(n_regionkey + 0.5D as string)", ["target"])
    return generators.generate(spark, "matrix from file", path=path, target_path=target).select("col_id", F.posexplode("vec").alias("i", "v"), "y")


@query("submatrix_gather", f"WITH s AS (SELECT vec_id FROM embeddings ORDER BY {uniform_sql(5, 0, 0, 'vec_id')}, vec_id LIMIT 70) SELECT vec_id AS col_id, CAST(unnest(range(64)) AS INTEGER) AS i, round(CAST(unnest(embedding) AS DOUBLE), 6) AS v FROM embeddings WHERE vec_id IN (SELECT vec_id FROM s)")
def gather_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = embeddings_matrix(spark, sf_dir)
    return gather(x, select_subset(x, 70, "random columns", path="distributed", seed=5)).select("col_id", F.posexplode("vec").alias("i", "v")).withColumn("v", F.round("v", 6))


@query("unselected_pad", "SELECT vec_id AS col_id FROM embeddings WHERE vec_id % 10 = 3 UNION ALL (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 3 ORDER BY vec_id LIMIT greatest(0, 260 - (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 3)))")
def pad_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = embeddings_matrix(spark, sf_dir)
    return pad_selection(x, x.filter("col_id % 10 = 3").select("col_id"), 260)


# --- tensor trains --------------------------------------------------------------------------------


def example_core(left: int, mode: int, right: int, salt: int) -> np.ndarray:
    """Unfolding entry (i, j): 1 + (7 i + 3 j + 5 salt) mod 11."""
    u = np.array([[1 + (7 * i + 3 * j + 5 * salt) % 11 for j in range(right)] for i in range(left * mode)], float)
    return u.reshape(mode, left, right).transpose(1, 0, 2)


def example_train(salt: int = 0) -> list[np.ndarray]:
    return [example_core(1, 3, 2, salt + 1), example_core(2, 4, 3, salt + 2), example_core(3, 2, 1, salt + 3)]


def _train_sql(salt: int = 0) -> str:
    shapes = [(1, 3, 2), (2, 4, 3), (3, 2, 1)]
    return " UNION ALL ".join(f"SELECT {k} AS core, a, i, c, CAST(1 + (7 * (a + {l} * i) + 3 * c + 5 * {salt + k + 1}) % 11 AS DOUBLE) AS v FROM range({l}) AS x(a), range({n}) AS y(i), range({r}) AS z(c)" for k, (l, n, r) in enumerate(shapes))


@query("tt_to_dense", f"WITH t AS ({_train_sql()}) SELECT x.i + 3 * y.i + 12 * z.i AS index, sum(x.v * y.v * z.v) AS v FROM t x JOIN t y ON x.core = 0 AND y.core = 1 AND x.c = y.a JOIN t z ON z.core = 2 AND y.c = z.a GROUP BY 1")
def dense_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.to_dense(tt.train_table(spark, example_train()), [3, 4, 2])


@query("tt_mode_slice", f"WITH t AS ({_train_sql()}) SELECT CAST(a AS INTEGER) AS a, CAST(c AS INTEGER) AS c, v FROM t WHERE core = 1 AND i = 2")
def slice_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.mode_slice(tt.train_table(spark, example_train()), 1, 2)


def operator_train() -> list[np.ndarray]:
    """Operators of rank 1 with as many outputs as inputs."""
    return [example_core(1, n * n, 1, 9 + k) for k, n in enumerate((3, 4, 2))]


_OPERATOR_SQL = " UNION ALL ".join(f"SELECT {k} AS core, {n} AS size, i, CAST(1 + (7 * i + 5 * {9 + k}) % 11 AS DOUBLE) AS v FROM range({n * n}) AS x(i)" for k, n in enumerate((3, 4, 2)))


@query("tt_zip", f"WITH t AS ({_train_sql()}), o AS ({_OPERATOR_SQL}) SELECT t.core, CAST(a AS INTEGER) AS a, CAST(o.i % size AS INTEGER) AS i, CAST(c AS INTEGER) AS c, sum(o.v * t.v) AS v FROM o JOIN t ON o.core = t.core AND o.i // size = t.i GROUP BY 1, 2, 3, 4")
def zip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.zip_trains(tt.train_table(spark, operator_train()), tt.train_table(spark, example_train()), {0: 3, 1: 4, 2: 2})


@query("tt_absorb", f"WITH t AS ({_train_sql()}) SELECT CAST(p AS INTEGER) AS a, CAST(i AS INTEGER) AS i, CAST(c AS INTEGER) AS c, sum((p + 2 * a + 1) * v) AS v FROM t, range(3) AS r(p) WHERE core = 1 GROUP BY 1, 2, 3")
def absorb_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = spark.createDataFrame([(p, q, float(p + 2 * q + 1)) for p in range(3) for q in range(2)], "p int, q int, v double")
    return tt.absorb_left(tt.train_table(spark, example_train()), 1, factor)


@query("tt_rank_truncation", "WITH s AS (SELECT k AS idx, 8.0 / pow(2, k) AS s FROM range(10) AS r(k)), t AS (SELECT idx, sum(s * s) OVER (ORDER BY idx DESC) AS tail, sum(s * s) OVER () AS total FROM s) SELECT CAST(greatest(1, count(*)) AS INTEGER) AS r FROM t WHERE tail > 0.0004 * total")
def truncation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.truncated_rank(spark.range(10).select(F.col("id").alias("idx"), (8.0 / F.pow(F.lit(2.0), F.col("id"))).alias("s")), 0.0, 0.02)


def _fibers(spark: SparkSession, value: float) -> DataFrame:
    skeleton = tt.Skeleton([3, 4, 2], [[(0, -1), (2, -1)], [(1, 0), (3, 1)]], [[(0, 0), (2, 1)], [(0, -1), (1, -1)]])
    slabs = [np.full((skeleton.left_count(k), n, skeleton.right_count(k)), value + k) for k, n in enumerate((3, 4, 2))]
    return tt.fibers_table(spark, slabs)


_FIBER_SQL = "SELECT CAST(0 AS BIGINT) AS skel_id, CAST(k AS INTEGER) AS core, p AS left_node, i AS mode, q AS right_node, CAST({value} AS DOUBLE) AS v FROM range(3) AS c(k), range(2) AS x(p), range(4) AS y(i), range(2) AS z(q) WHERE i < CASE k WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 2 END AND (k > 0 OR p = 0) AND (k < 2 OR q = 0)"


@query("fibers_add", _FIBER_SQL.format(value="7 + 2 * k"))
def fibers_add_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.fibers_add(_fibers(spark, 2.0), _fibers(spark, 5.0))


@query("fibers_hadamard", _FIBER_SQL.format(value="(2 + k) * (5 + k)"))
def fibers_hadamard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.fibers_hadamard(_fibers(spark, 2.0), _fibers(spark, 5.0))


@query("fiber_tuples", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), '0,1'), (CAST(1 AS BIGINT), '2,3')) AS t(node, modes)")
def fiber_tuples_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index tuples of the last left bond, by a recursive query over the node table."""
    skeleton = tt.Skeleton([3, 4, 2], [[(0, -1), (2, -1)], [(1, 0), (3, 1)]], [[(0, 0), (2, 1)], [(0, -1), (1, -1)]])
    skeleton.table(spark).createOrReplaceTempView("fiber_nodes")
    return spark.sql("""
        WITH RECURSIVE t(bond, node, modes) AS (
            SELECT bond, node, cast(mode AS string) FROM fiber_nodes WHERE side = 'left' AND bond = 0
            UNION ALL
            SELECT n.bond, n.node, concat(t.modes, ',', cast(n.mode AS string)) FROM t JOIN fiber_nodes n ON n.side = 'left' AND n.bond = t.bond + 1 AND n.parent = t.node)
        SELECT node, modes FROM t WHERE bond = 1
    """)


@query("tt_cross")
def cross_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip: select a skeleton, evaluate its fibers, interpolate, and flatten; equals tt_to_dense."""
    skeleton, slabs = tt.select_indices(tt.collect_cores(tt.train_table(spark, example_train())))
    cores = tt.cores_from_fibers(slabs, skeleton)
    return tt.to_dense(tt.train_table(spark, cores), [3, 4, 2]).withColumn("v", F.round("v", 6))


ORACLES["tt_cross"] = ORACLES["tt_to_dense"].replace("sum(x.v * y.v * z.v)", "round(sum(x.v * y.v * z.v), 6)")


@query("tt_compress", ORACLES["tt_cross"])
def compress_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = tt.compress(tt.collect_cores(tt.train_table(spark, example_train())), rtol=1e-12)
    return tt.to_dense(tt.train_table(spark, cores), [3, 4, 2]).withColumn("v", F.round("v", 6))


@query("tt_left_orthogonalize", ORACLES["tt_cross"])
def left_orthogonal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = tt.left_orthogonalize(tt.collect_cores(tt.train_table(spark, example_train())))
    return tt.to_dense(tt.train_table(spark, cores), [3, 4, 2]).withColumn("v", F.round("v", 6))


@query("tt_right_orthogonalize", ORACLES["tt_cross"])
def right_orthogonal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = tt.right_orthogonalize(tt.collect_cores(tt.train_table(spark, example_train())))
    return tt.to_dense(tt.train_table(spark, cores), [3, 4, 2]).withColumn("v", F.round("v", 6))


@query("tt_at_fibers", f"WITH d AS ({ORACLES['tt_to_dense']}) SELECT p AS left_node, i AS mode, q AS right_node, round(v, 6) AS v FROM (VALUES (CAST(0 AS BIGINT), 0), (1, 2)) AS l(p, m0), range(4) AS y(i), (VALUES (CAST(0 AS BIGINT), 0), (1, 1)) AS r(q, m2) JOIN d ON d.index = m0 + 3 * i + 12 * m2")
def at_fibers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle slab of a given skeleton."""
    skeleton = tt.Skeleton([3, 4, 2], [[(0, -1), (2, -1)], [(1, 0), (3, 1)]], [[(0, 0), (2, 1)], [(0, -1), (1, -1)]])
    slabs = tt.fibers_table(spark, tt.fibers_of(tt.collect_cores(tt.train_table(spark, example_train())), skeleton))
    return slabs.filter("core = 1").select("left_node", "mode", "right_node", F.round("v", 6).alias("v"))


@query("tt_absorb_right", f"WITH t AS ({_train_sql()}) SELECT CAST(a AS INTEGER) AS a, CAST(i AS INTEGER) AS i, CAST(p AS INTEGER) AS c, sum((p + 2 * c + 1) * v) AS v FROM t, range(2) AS r(p) WHERE core = 1 GROUP BY 1, 2, 3")
def absorb_right_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = spark.createDataFrame([(p, q, float(p + 2 * q + 1)) for p in range(2) for q in range(3)], "p int, q int, v double")
    return tt.absorb_right(tt.train_table(spark, example_train()), 1, factor)


@query("singular_values")
def singular_values_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prep.singular_values(customer_matrix(spark, sf_dir))
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(s)], "idx int, s double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the embeddings matrix by leverage: the top 80, with their scores."""
    x = leverage(embeddings_matrix(spark, sf_dir))
    return x.orderBy(F.round("w", 12).desc(), "col_id").limit(80).select("col_id", F.round("w", 9).alias("w"), F.row_number().over(Window.orderBy(F.round("w", 12).desc(), "col_id")).alias("rank"))


QUERIES["flagship"] = flagship
