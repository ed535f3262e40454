"""Whitening of embeddings from column aggregates.

One aggregation sums the centred products of every pair of dimensions: a column for
each pair within two blocks of them, a group for each two blocks.  The covariance
matrix that they make is decomposed by LAPACK on the driver, and the vectors are
projected by array functions.  Entries are integers in fixed point, so that sums
are the same in any order.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import stored

#: Fixed point of a component c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Fixed-point values are held within this, where doubles are exact integers.
MOST = 1 << 52
#: Dimensions in a block: the products of two blocks are sums side by side, few enough for Spark to compile them into one loop.
BLOCK = 8
LONG = 1 << 63
EXACT = "decimal(38,0)"


class Model(NamedTuple):
    """Of vectors of one length: their number, sums, and the components (as rows) with their variances, largest first."""

    n: int
    sums: list[int]
    variances: np.ndarray
    directions: np.ndarray
    trace: float

    @property
    def usable(self) -> list[bool]:
        """Whether a component has a variance that is more than rounding."""
        return [bool(e > self.trace * len(self.sums) * 2.0**-52) for e in self.variances]


def fixed(c: Column) -> Column:
    """A finite number in fixed point; what is beyond MOST counts as that."""
    scaled = F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST))))
    return scaled.cast("long") + SHIFT


def finite(v: str) -> Column:
    inf = float("inf")
    return F.col(v).isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < inf), F.lit(False)))


def moments(vectors: DataFrame) -> dict[int, list]:
    """By the length of vectors: per dimension their number and the sum, least and largest of fixed-point values."""
    each = vectors.select(F.size("v").alias("size"), F.posexplode("v").alias("i", "c")).select("size", "i", fixed(F.col("c")).alias("x"))
    found = each.groupBy("size", "i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high"))
    out: dict[int, list] = {}
    for r in sorted(found.collect(), key=lambda r: (r["size"], r["i"])):  # a row for each dimension of a length
        out.setdefault(r["size"], []).append((r["n"], int(r["s"]), r["low"], r["high"]))
    return out


def covariance(vectors: DataFrame, known: list) -> np.ndarray:
    """The covariance matrix, divisor n, of the fixed-point vectors; known: their moments.

    Values are centred on the integer next to the mean before they are multiplied,
    which is made up for exactly in the end.  Where a sum might leave a long,
    doubles centred on the mean are summed instead.
    """
    d, n = len(known), known[0][0]
    sums = [s for _, s, _, _ in known]
    near = [(2 * s + n) // (2 * n) for s in sums]
    spread = max(max(abs(high - m), abs(low - m)) for (_, _, low, high), m in zip(known, near, strict=True))
    exact = spread * spread * n < LONG
    middle = [F.lit(m) for m in near] if exact else [F.lit(s / n) for s in sums]
    centred = [fixed(F.get("v", F.lit(i))) - m for i, m in enumerate(middle)]
    # a row per vector and pair of blocks on or above the diagonal, summed where it arises; the last block is filled up with zeros
    starts = range(0, d, BLOCK)
    zero = F.lit(0).cast("long" if exact else "double")
    blocks = F.array(*(F.array(*(centred[i] if i < d else zero for i in range(a, a + BLOCK))) for a in starts))
    upper = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(len(starts)) for b in range(a, len(starts))))
    each = vectors.select(blocks.alias("b")).select("b", F.explode(upper).alias("at")).select("at", F.get("b", F.col("at.a")).alias("x"), F.get("b", F.col("at.b")).alias("y"))
    pairs = [(i, j) for i in range(BLOCK) for j in range(BLOCK)]
    cells = each.select("at", *(F.get(c, F.lit(i)).alias(f"{c}{i}") for c in "xy" for i in range(BLOCK)))
    sums_of = [F.sum(F.col(f"x{i}") * F.col(f"y{j}")).alias(f"p{k}") for k, (i, j) in enumerate(pairs)]
    made: dict[tuple[int, int], int | float] = {}
    for row in cells.groupBy("at").agg(*sums_of).collect():  # d * d numbers in all
        a, b = (starts[k] for k in row["at"])
        made |= {(a + i, b + j): row[f"p{k}"] for k, (i, j) in enumerate(pairs) if a + i < d and b + j < d}
    v = np.empty((d, d))
    for (i, j), p in made.items():
        off_i, off_j = (sums[k] - n * near[k] for k in (i, j))
        v[i, j] = v[j, i] = (n * p - off_i * off_j) / (n * n) if exact else p / n
    return v


def fit(vectors: DataFrame, known: list, components: int) -> Model:
    """The model of the finite vectors, all of one length, in column v; known: their moments."""
    cov = covariance(vectors, known)
    e, u = np.linalg.eigh(cov)
    first = np.argsort(-e, kind="stable")[:components]
    return Model(known[0][0], [s for _, s, _, _ in known], e[first], u[:, first].T, float(np.trace(cov)))


def deviation(model: Model, spread: int) -> Column:
    """The sum over dimensions of (n * x - S)^2 as decimal(38,0), exact; null if it has more digits.

    spread: no |x - mean| is larger.
    """
    d, n = len(model.sums), model.n
    if ((spread + 1) * n) ** 2 * d < LONG:
        sums = F.array(*(F.lit(s) for s in model.sums)).cast("array<bigint>")
        return F.aggregate(F.zip_with("x", sums, lambda x, s: x * n - s), F.lit(0).cast("long"), lambda t, y: t + y * y).cast(EXACT)
    sums = F.array(*(F.lit(str(s)).cast(EXACT) for s in model.sums))
    apart = F.zip_with("x", sums, lambda x, s: F.try_subtract(F.try_multiply(x.cast("decimal(19,0)"), F.lit(str(n)).cast("decimal(18,0)")), s).cast(EXACT))
    return F.aggregate(apart, F.lit("0").cast(EXACT), lambda t, y: F.try_add(t, F.try_multiply(y, y)).cast(EXACT))


def whitened(model: Model) -> Column:
    """The values of the centred vector in column y on all components; null on one without variance."""

    def on(e: float, u: np.ndarray) -> Column:
        weights = F.array(*(F.lit(float(c)) for c in u / np.sqrt(e)))
        return F.aggregate(F.zip_with("y", weights, lambda y, w: y * w), F.lit(0.0), lambda t, x: t + x)

    return F.array(*(on(e, u) if ok else F.lit(None).cast("double") for e, u, ok in zip(model.variances, model.directions, model.usable, strict=True)))


def identity_error(rows: DataFrame, usable: list[bool]) -> float | None:
    """The largest entry of |covariance of the whitened values w - identity|, over components with a variance."""
    own = [i for i, ok in enumerate(usable) if ok]
    if not own:
        return None
    columns = rows.select(*(F.get("w", F.lit(i)).alias(f"w{i}") for i in own))
    pairs = [(i, j) for i in own for j in own if i <= j]
    found = columns.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"p{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"p{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(table: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, exact_deviation) per vector and component.

    Rows whose vector is null or holds a null or non-finite entry are dropped.
    Vectors of another length are another fit list, with a model of their own; an
    empty vector has no components, one of fewer entries than `components` as many
    as entries.  A component has no variance if its eigenvalue is that of rounding
    (fewer different vectors than dimensions): whitened is null then, and
    identity_error leaves it out; explained is null if the whole trace is 0.
    Entries of more than 2^52 / 1024 count as that.  deviation is null where it is
    no long (at about 10^9 vectors); exact_deviation has it up to 38 digits.  Null
    and repeated ids are rows of their own, other columns are ignored.
    """
    vectors = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(finite("v"))
    parts = []
    for size, known in moments(vectors).items():
        own = vectors.where(F.size("v") == size)
        model = fit(own, known, components)
        spread = max(max(high - s // n, s // n - low) for n, s, low, high in known)
        means = F.array(*(F.lit(s / model.n) for s in model.sums))
        rows = own.select("id", F.transform("v", fixed).alias("x")).select("id", "x", F.zip_with("x", means, lambda x, m: x.cast("double") - m).alias("y"))
        rows = stored(rows.select("id", deviation(model, spread).alias("exact"), whitened(model).alias("w")), "whitened")
        error = F.lit(identity_error(rows, model.usable)).cast("double")
        shares = F.array(*(F.lit(float(e) / model.trace if model.trace > 0 else None).cast("double") for e in model.variances))
        each = rows.select("id", "exact", F.posexplode(F.arrays_zip("w", shares.alias("share"))).alias("i", "c"))
        parts.append(each.select(
            F.col("id").alias(id_col), (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("exact").try_cast("bigint").alias("deviation"), F.col("c.w").alias("whitened"),
            F.col("c.share").alias("explained"), error.alias("identity_error"), F.col("exact").alias("exact_deviation"),
        ))
    none = f"component int, n long, deviation long, whitened double, explained double, identity_error double, exact_deviation {EXACT}"
    empty = table.sparkSession.createDataFrame([], T.StructType([T.StructField(id_col, table.schema[id_col].dataType), *T._parse_datatype_string(none)]))
    return reduce(DataFrame.unionByName, parts) if parts else empty
