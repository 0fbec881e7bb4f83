"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives a vector a long string of bits, the sides of random planes that it lies on, and keeps the strings of its
rows sorted. A query descends each tree to its longest common prefix and then ascends in all trees at once, a bit a
step, until the rows that share so long a prefix are enough; those are compared exactly. Rows with equal prefixes lie
side by side, so a step up widens one range in each sorted array.

Index rows and queries are dealt out in blocks; each pair of blocks is one group, and builds its rows' forest once. Equal vectors
are indexed once with their smallest ids, as many as any query can need."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._util import cut, prepare

TREES, BITS = 16, 32
#: Rows that trees offer a query, copies of one row counted in each tree, as a share of a block's rows.
SHARE = 1.6
#: Rows and queries of one group, and queries that are looked up together.
INDEX_BLOCK, QUERY_BLOCK, AT_ONCE = 8192, 8192, 1024
SALTS = 16


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.x, self.bits = x, bits
        self.planes = np.random.default_rng(seed).standard_normal((trees, x.shape[1], bits))
        self.order, self.strings = [], []
        for p in self.planes:
            s = self.hash(x, p)
            o = np.argsort(s, kind="stable")
            self.order.append(o)
            self.strings.append(s[o])

    def hash(self, x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return ((x @ planes > 0) @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).astype(np.int64)

    def candidates(self, queries: np.ndarray, least: int, different: int = 0):
        """For each query the rows found when at least `least` are offered, a row once for each tree, and `different` rows are among them, or all."""
        n, t, levels = len(queries), len(self.planes), self.bits + 1
        lo, hi = np.zeros((levels, t, n), np.int64), np.zeros((levels, t, n), np.int64)
        for k, (p, s) in enumerate(zip(self.planes, self.strings, strict=True)):
            q = self.hash(queries, p)
            for shared in range(levels):
                up = self.bits - shared
                lo[shared, k] = np.searchsorted(s, (q >> up) << up)
                hi[shared, k] = np.searchsorted(s, ((q >> up) + 1) << up)
        offered = (hi - lo).sum(1)
        for i in range(n):
            enough = np.flatnonzero(offered[:, i] >= least)
            level = int(enough[-1]) if len(enough) else 0
            hit = np.zeros(len(self.x), bool)
            for level in range(level, -1, -1):
                for k, o in enumerate(self.order):
                    hit[o[lo[level, k, i] : hi[level, k, i]]] = True
                if hit.sum() >= different:
                    break
            yield np.flatnonzero(hit)


def vectors(column) -> np.ndarray:
    """An Arrow column of lists of equal length as a matrix in double precision."""
    c = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(c), -1)


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), <id_col> and score (inner product of the vectors as given): each query's k nearest found, ties to smaller ids.

    `queries`: rows like df's. A query's own id is no candidate. Vectors that are null, zero, hold null or non-finite
    components, or are not of the commonest length take no part, nor do rows without an id; ids that repeat with one
    vector count once. With no vectors or queries there are no rows."""
    import pyarrow as pa

    prepare(df.sparkSession)

    def usable(d):
        v = F.col(vec_col)
        d = d.select(F.col(id_col).alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & v.isNotNull())
        return d.where(F.expr("size(vec) > 0 and forall(vec, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(vec, c -> c <> 0)"))

    kind = df.schema[id_col].dataType.simpleString()
    size = usable(df).groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    rows, asked = (usable(d).where(F.size("vec") == size["n"]).withColumn("h", F.xxhash64("vec")).distinct() for d in (df, queries))
    keep = k + 1  # one may be the query's own
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for by in (["h", "vec", "salt"], ["h", "vec"]):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= keep)
    rows = cut(rows.groupBy("h", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vid", F.col("ids")[0]))
    asked = cut(asked.join(rows.select("h", "vec", "vid"), ["h", "vec"]).select("id", F.col("vid").alias("of")))
    need = rows.join(asked.select("of").distinct(), F.col("vid") == F.col("of"), "left_semi").select("vid", "vec")
    n, m = rows.count(), need.count()
    a, b = max(1, -(-n // INDEX_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    block = lambda of, into: F.pmod(F.xxhash64(F.col(of)), F.lit(into)).cast("int")
    left = need.select(F.col("vid").alias("qvid"), F.col("vec").alias("qvec"), block("vid", b).alias("qqb"), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("qib"))
    right = rows.select("vid", "vec", "ids", block("vid", a).alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("qb"))

    def run(q, x):
        names = ["vid", "cand", "score", "ids"]
        id_type = x["vid"].type
        if not q.num_rows or not x.num_rows:
            return pa.table({"vid": pa.array([], id_type), "cand": pa.array([], id_type), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(id_type))})
        x = x.sort_by("vid")
        base, ask = vectors(x["vec"]), vectors(q["qvec"])
        out_q, out_c, out_s = [], [], []
        forest, least_rows = Forest(base, trees), int(share * len(base)) + keep
        every = (c for k in range(0, len(ask), AT_ONCE) for c in forest.candidates(ask[k : k + AT_ONCE], least_rows, keep))
        for i, c in enumerate(every):
            s = base[c] @ ask[i]
            if len(c) > keep:
                least = np.partition(s, len(s) - keep)[len(s) - keep]
                at = np.flatnonzero(s >= least)
                at = at[np.argsort(-s[at], kind="stable")][:keep]  # rows are in id order
            else:
                at = np.arange(len(c))
            out_q.append(np.full(len(at), i))
            out_c.append(c[at])
            out_s.append(s[at])
        c, qi = pa.array(np.concatenate(out_c)), pa.array(np.concatenate(out_q))
        return pa.table([q["qvid"].take(qi), x["vid"].take(c), pa.array(np.concatenate(out_s), pa.float64()), x["ids"].take(c).cast(pa.list_(id_type))], names=names)

    found = left.groupBy("qib", "qqb").cogroup(right.groupBy("ib", "qb")).applyInArrow(run, f"vid {kind}, cand {kind}, score double, ids array<{kind}>")
    top = lambda d, by, *order: d.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    found = top(found, "vid", F.desc("score"), "cand").where(F.col("r") <= keep)
    found = top(found.select("vid", "score", F.explode("ids").alias("got")), "vid", F.desc("score"), "got").where(F.col("r") <= keep).drop("r")
    out = top(asked.join(found, F.col("of") == F.col("vid")).where("id <> got"), "id", F.desc("score"), "got").where(F.col("r") <= k)
    return out.select(F.col("id").alias("query_id"), F.col("r").cast("int").alias("rank"), F.col("got").alias(id_col), "score")
