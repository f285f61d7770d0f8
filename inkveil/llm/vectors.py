"""Approximate nearest neighbours: randomly rotated one-bit codes with error bounds.

Unit vectors are centred, padded to CODE_BITS dimensions and rotated by a seeded random orthogonal matrix; a
code keeps one sign bit for each dimension, and beside it the distance from the centre and the inner product
of the vector with its code. From these follow an unbiased estimate of a cosine and a bound of its error.
Every vector is coded where it lies; its code, its components rounded to one byte each and a few scalars are
sent to the stated queries, in blocks. A task meets a block of queries with GROUP blocks of codes, one after another.
What the upper bound of its code lets reach a query's K-th best lower bound so far is ranked again by the rounded
components, with the exact bound that the length of the rounding error gives. What is left after all tasks, little
more than K a task, is ranked by exact cosines in double precision, for which those vectors are fetched.

Equal vectors form one class, of which the smallest ids are kept: a class of any size costs one code.

Defined cases: vectors that are null, zero, of another length than the longest, or hold null or non-finite
components take no part, nor do rows of a null vec_id; ties go to the smaller vec_id; rows that repeat a query's vec_id are not its neighbours,
and a repeated query id has one answer a row; fewer candidates than K give fewer rows; an empty table gives no
rows; columns other than vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from inkveil.llm.common import drop_written, small_batches, table, trimmed, written

K, EVERY, SEED = 5, 50, 20240
#: Bits of a code (a vector's own dimensions, if more), and the width of the error bound in standard deviations.
CODE_BITS, SPREAD = 256, 3.0
CODE_BLOCK, QUERY_BLOCK, GROUP = 4096, 1024, 32
#: Queries that are estimated against a block at once.
AT_ONCE = 128


def rotation(dims: int, bits: int, seed: int = SEED) -> np.ndarray:
    """dims x bits with orthonormal rows: a random rotation of zero-padded vectors."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dims].astype(np.float32)


def encode(unit: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, distances from the centre, inner products of the centred unit vectors with their codes."""
    rest = unit - centre
    norm = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(norm, 1e-12)[:, None]).astype(np.float32) @ turn
    bits = turned > 0
    own = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(bits, axis=1), norm, np.maximum(own, 1e-6)


def estimate(codes: np.ndarray, norm: np.ndarray, own: np.ndarray, centred: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, spread: float = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines, queries x codes, and the half widths of their bounds. centred: inner products of the coded vectors with the centre."""
    bits = turn.shape[1]
    rest = queries - centre
    qn = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(qn, 1e-12)[:, None]).astype(np.float32) @ turn
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    inner = turned @ signs.T / np.sqrt(bits) / own
    scale = qn[:, None] * norm
    error = spread * np.sqrt(np.maximum(0, 1 - own**2)) / own / np.sqrt(bits - 1)
    return scale * inner + centred + (queries @ centre)[:, None] - centre @ centre, scale * error + 1e-6


#: Of each vector: distance from the centre, inner products with its code and the centre, step and error length of its rounded components.
SCALARS = ("norm", "own", "centred", "step", "off")


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components in 127ths of the largest, that step, and a bound of what an inner product with another unit vector may be off."""
    step = np.abs(unit).max(axis=1) / 127
    fine = np.rint(unit / step[:, None]).astype(np.int8)
    return fine, step, np.linalg.norm(unit - fine * step[:, None], axis=1) + 1e-5


def centre_of(classes: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """Mean of the unit vectors, and their number: a row of sums a task."""

    def run(batches):
        total, n = np.zeros(dims), 0
        for b in batches:
            unit = _units(b.column(0), dims)[0]
            total, n = total + unit.sum(axis=0), n + len(unit)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n])], ["sums", "n"])

    rows = classes.select("e").mapInArrow(trimmed(run), "sums array<double>, n long").filter("n > 0").collect()
    n = sum(r.n for r in rows)
    return np.sum([r.sums for r in rows], axis=0) / max(n, 1) if rows else np.zeros(dims), n


def _units(col: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths of a column of vectors."""
    x = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), np.float64)
    n = np.linalg.norm(x, axis=1)
    return x / n[:, None], n


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, bits: int = CODE_BITS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id every divides, its k nearest other rows."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = vectors.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    v = v.filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    v = v.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    v = v.select("vec_id", "e", F.unhex(F.md5(F.concat_ws(",", F.col("e").cast("array<string>")))).alias("key"))
    dims = v.agg(F.max(F.size("e"))).first()[0] or 1
    v = v.filter(F.size("e") == dims)
    members = v.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    members = written(members.select("key", "vec_id", "n", F.when(F.col("n") == 1, F.col("e")).alias("e")), "ann-members")
    queries = v.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "key")
    classes = members.filter("n = 1").select("key", "e")
    asked = written(queries.select("key").distinct().join(classes, "key"), "ann-asked")
    centre, total = centre_of(classes, dims)
    turn = rotation(dims, max(bits, dims))
    code_blocks = max(1, -(-total // CODE_BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    groups = -(-code_blocks // GROUP)
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def code(batches):
        for b in batches:
            unit = _units(b.column(1), dims)[0]
            if len(unit):
                codes, norms, own = encode(unit, centre, turn)
                fine, step, off = rounded(unit)
                blobs = [pa.array([c.tobytes() for c in x], pa.binary()) for x in (codes, fine)]
                yield pa.RecordBatch.from_arrays([b.column(0), *blobs, *[pa.array(x.astype(np.float64)) for x in (norms, own, unit @ centre, step, off)]], ["key", "code", "fine", *SCALARS])

    def pack(t: pa.Table) -> pa.Table:
        """A block of codes as one row."""
        blob = lambda c: b"".join(t.column(c).to_pylist())
        scalars = np.stack([t.column(c).to_numpy() for c in SCALARS])
        return pa.table([t.column("b")[:1], *[pa.array([x], pa.binary()) for x in (blob("key"), blob("code"), blob("fine"), scalars.tobytes())]], ["b", "keys", "codes", "fine", "scalars"])

    coded = classes.mapInArrow(trimmed(code), "key binary, code binary, fine binary, " + ", ".join(f"{c} double" for c in SCALARS)).withColumn("b", block(code_blocks))
    coded = written(coded.groupBy("b").applyInArrow(pack, "b long, keys binary, codes binary, fine binary, scalars binary"), "ann-codes")
    # Each block of codes meets each block of queries; a task has one block of queries and one group of code blocks.
    left = coded.withColumn("g", F.floor(F.col("b") / GROUP)).withColumn("q", upto(query_blocks))
    right = asked.withColumn("q", block(query_blocks)).withColumn("g", upto(groups))

    def scan(codes: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(codes) or not len(asked):
            return pa.table([pa.array([], pa.binary()), pa.array([], pa.binary()), pa.array([], pa.float64()), pa.array([], pa.float64())], ["qkey", "key", "low", "high"])
        unit, most = _units(asked.column("e").combine_chunks(), dims)[0], k + 1
        best = np.full(len(unit), -np.inf)  # of each query, the K-th best lower bound so far, itself counted
        qi, key, low, high = np.zeros(0, np.int64), np.zeros(0, "V16"), np.zeros(0), np.zeros(0)
        for r in codes.select(["keys", "codes", "fine", "scalars"]).to_pylist():
            keys = np.frombuffer(r["keys"], "V16")
            norms, own, centred, step, off = np.frombuffer(r["scalars"]).reshape(len(SCALARS), -1)
            bits_ = np.frombuffer(r["codes"], np.uint8).reshape(len(keys), -1)
            fine = np.frombuffer(r["fine"], np.int8).reshape(len(keys), -1).astype(np.float32) * step[:, None].astype(np.float32)
            for x in range(0, len(unit), AT_ONCE):
                some = unit[x : x + AT_ONCE]
                est, err = estimate(bits_, norms, own, centred, some, centre, turn)
                floor = best[x : x + AT_ONCE]
                if len(keys) >= most:
                    floor = np.maximum(floor, np.partition(est - err, len(keys) - most, axis=1)[:, len(keys) - most])
                i, c = np.nonzero(est + err >= floor[:, None])
                near = np.einsum("ij,ij->i", some.astype(np.float32)[i], fine[c]).astype(np.float64)
                stay = near + off[c] >= best[x + i]
                i, c, near = i[stay], c[stay], near[stay]
                qi, key = np.concatenate([qi, x + i]), np.concatenate([key, keys[c]])
                low, high = np.concatenate([low, near - off[c]]), np.concatenate([high, near + off[c]])
            order = np.lexsort((-low, qi))
            qi, key, low, high = qi[order], key[order], low[order], high[order]
            at = np.searchsorted(qi, np.arange(len(unit))) + most - 1
            full = (at < len(qi)) & (np.append(qi, -1)[np.minimum(at, len(qi))] == np.arange(len(unit)))
            best = np.where(full, np.append(low, 0)[np.minimum(at, len(low))], best)
            stay = high >= best[qi]
            qi, key, low, high = qi[stay], key[stay], low[stay], high[stay]
        qkeys = asked.column("key").combine_chunks()
        return pa.table([qkeys.take(pa.array(qi)), pa.array([x.tobytes() for x in key], pa.binary()), pa.array(low), pa.array(high)], ["qkey", "key", "low", "high"])

    met = left.groupBy("q", "g").cogroup(right.groupBy("q", "g")).applyInArrow(scan, "qkey binary, key binary, low double, high double")
    found = written(met, "ann-bounds")
    kth = F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("low")))
    floors = found.withColumn("r", kth).filter(F.col("r") <= k + 1).groupBy("qkey").agg(F.count("*").alias("c"), F.min("low").alias("floor"))
    left_over = found.join(floors, "qkey").filter((F.col("c") <= k) | (F.col("high") >= F.col("floor"))).select("qkey", "key")

    def rank(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_cosines(b.column(2), b.column(3), dims))], ["qkey", "key", "score"])

    pairs = left_over.join(classes, "key").join(asked.select(F.col("key").alias("qkey"), F.col("e").alias("q")), "qkey").select("qkey", "key", "e", "q")
    ranked = written(pairs.mapInArrow(trimmed(rank), "qkey binary, key binary, score double"), "ann-found")
    first = members.filter("n = 1").select("key", F.col("vec_id").alias("first"))
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "first")
    top = ranked.join(first, "key").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    each = top.join(members.select("key", "vec_id"), "key").select("qkey", "vec_id", "score")
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    lists = each.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    drop_written(coded, found)
    out = queries.join(lists, queries.key == lists.qkey).select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x.vec_id != F.col("query_id")), 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _cosines(a: pa.Array, b: pa.Array, dims: int) -> np.ndarray:
    """Row by row, in double precision on the vectors as they are."""
    x, y = (np.ascontiguousarray(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), np.float64) for c in (a, b))
    return (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES, ORACLES = {"op7_nearest": op7_nearest}, {}
