"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are signs of rotated principal components; each rotation is fitted so that signs lose little
(iterative quantisation), and vectors of fewer dimensions than bits get several rotations of their
own.  A code is cut into substrings of 16 bits, each with an index of its own.  Two codes within
``(reach + 1) * substrings - 1`` bits agree in some substring up to ``reach`` bits, so probing all
values that near in every index finds every code within that radius, and many beyond it.  Those
found that are within ``limit`` bits are ranked by the cosine of the vectors themselves.  ``reach``
and ``limit`` are fitted on a sample; in a larger table neighbours are nearer than in its sample.
A query that finds too few is compared with every vector.

A block of vectors has the indexes of its own codes, a block of queries meets every block of
vectors once, and returns the best few of each query.  Both have bounded bytes, and blocks are
dealt by row, so that equal vectors share no block by being equal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.words import ranges
from codestrata.scale import materialize

# Vectors and bytes of the sample that codes are fitted to; queries of it that fit the radius.
SAMPLE_VECTORS, SAMPLE_BYTES, LEAST_SAMPLE = 20_000, 32 * 1024 * 1024, 256
SAMPLE_QUERIES = 200
# Bits of a code, a multiple of 64, and of a substring.
BITS, PART_BITS = 256, 16
ROUNDS = 20
# Share of the sample's true neighbours that probing reaches, and of those that are compared.
REACHED, COMPARED = 0.95, 0.98
BLOCK_BYTES = 8 * 1024 * 1024
NEAREST = 5

FOUND = "row long, query_id long, vec_id long, score double"


@dataclass
class Codes:
    """Mean and rotated axes that make a code of a vector, and how far to probe and to compare."""

    mean: np.ndarray
    axes: np.ndarray
    reach: int = PART_BITS
    limit: int = BITS

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector."""
        return np.packbits((unit(vectors) - self.mean) @ self.axes > 0, axis=1)

    @property
    def radius(self) -> int:
        """Distance within which probing finds every code."""
        return min((self.reach + 1) * (self.axes.shape[1] // PART_BITS) - 1, self.axes.shape[1])


class Index:
    """Of each substring of some codes, the codes in order of its value."""

    def __init__(self, packed: np.ndarray) -> None:
        self.words, parts = packed.view(np.uint64), packed.view(np.uint16)
        self.members = np.argsort(parts, axis=0, kind="stable").T.ravel()
        sizes = np.stack([np.bincount(p, minlength=1 << PART_BITS) for p in parts.T])
        self.starts = np.zeros((len(sizes), sizes.shape[1] + 1), np.int64)
        np.cumsum(sizes, axis=1, out=self.starts[:, 1:])
        self.starts += len(packed) * np.arange(len(sizes))[:, None]

    def probe(self, code: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Positions of the codes that share a substring with ``code`` up to one of the masks."""
        values = code.view(np.uint16)[:, None] ^ masks
        part = np.arange(len(values))[:, None]
        start = self.starts[part, values].ravel()
        size = self.starts[part, values.astype(np.int64) + 1].ravel() - start
        found = np.zeros(len(self.words), bool)
        found[self.members[ranges(start[size > 0], size[size > 0])]] = True
        return np.flatnonzero(found)

    def within(self, code: np.ndarray, at: np.ndarray, limit: int) -> np.ndarray:
        """Those of the positions whose codes differ in at most ``limit`` bits."""
        return at[np.bitwise_count(self.words[at] ^ code.view(np.uint64)).sum(axis=1) <= limit]


def unit(vectors: np.ndarray) -> np.ndarray:
    # By a power of two first, which is exact, as squares of very large or small ones are no doubles.
    _, power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    vectors = np.ldexp(vectors, -power)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between a row of bytes and each row of others."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def near_values(most: int) -> np.ndarray:
    """Differences between substrings, to combine by exclusive or, of at most ``most`` bits."""
    every = np.arange(1 << PART_BITS, dtype=np.uint16)
    return every[np.bitwise_count(every) <= most]


def _rotated(along: np.ndarray, noise: np.random.Generator) -> np.ndarray:
    """A rotation from a random start after which signs lose little of ``along``."""
    n = along.shape[1]
    turn, _ = np.linalg.qr(noise.standard_normal((n, n)))
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.sign(along @ turn).T @ along)
        turn = (left @ right).T
    return turn


def fit_codes(sample: np.ndarray, nearest: int = NEAREST) -> Codes:
    """Fit codes to a bounded sample, and how far its neighbours' codes are apart."""
    points = unit(sample)
    mean = points.mean(axis=0)
    centred = points - mean
    noise = np.random.default_rng(1)
    # Of the components' covariance, whose size does not depend on the sample's.
    _, main = np.linalg.eigh(centred.T @ centred)
    main = main[:, ::-1][:, :BITS]
    along = centred @ main
    turns = [main @ _rotated(along, noise) for _ in range(-(-BITS // main.shape[1]))]
    codes = Codes(mean, np.concatenate(turns, axis=1)[:, :BITS])
    if len(sample) < 2:
        return codes
    packed = codes(sample)
    chosen = np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int)
    in_part, in_all = [], []
    for n in chosen:
        near = points @ points[n]
        near[n] = -np.inf
        best = np.argsort(-near, kind="stable")[: min(nearest, len(sample) - 1)]
        in_all.append(distances(packed[best], packed[n]))
        apart = (packed[best] ^ packed[n]).reshape(len(best), -1, PART_BITS // 8)
        in_part.append(np.bitwise_count(apart).sum(axis=2).min(axis=1, initial=PART_BITS))
    codes.reach = int(np.quantile(np.concatenate(in_part), REACHED, method="higher"))
    codes.limit = int(np.quantile(np.concatenate(in_all), COMPARED, method="higher"))
    codes.limit = max(codes.limit, codes.radius)
    return codes


def valid(vector: Column) -> Column:
    """Whether a vector has only finite components, and one that is not zero."""
    doubles = vector.cast("array<double>")
    finite = F.forall(
        doubles,
        lambda x: F.coalesce(
            ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)
        ),
    )
    return F.coalesce(finite & F.exists(doubles, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _search(codes: Codes, nearest: int, probing: bool):
    """The best few of a block's vectors for each of its queries."""

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        names = ["row", "query_id", "vec_id", "score"]
        if not queries.num_rows or not vectors.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        points, asked = _matrix(vectors.column("vector")), _matrix(queries.column("vector"))
        rows, ids = (vectors.column(c).to_numpy() for c in ("row", "id"))
        own_rows, own_ids = (queries.column(c).to_numpy() for c in ("row", "id"))
        every = np.arange(len(points))
        if probing:
            index, own, masks = Index(codes(points)), codes(asked), near_values(codes.reach)
        points, asked = unit(points), unit(asked)
        found = []
        for n in range(len(asked)):
            at = every
            if probing:
                at = index.within(own[n], index.probe(own[n], masks), codes.limit)
            at = at[rows[at] != own_rows[n]]
            score = np.einsum("ij,j->i", points[at], asked[n])
            best = np.lexsort((ids[at], -score))[:nearest]
            found.append((np.full(len(best), own_rows[n]), np.full(len(best), own_ids[n]), ids[at[best]], score[best]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return search


def _found(
    queries: DataFrame, vectors: DataFrame, n_queries: int, n_vectors: int, codes: Codes, nearest: int, probing: bool
) -> DataFrame:
    """``(row, query_id, vec_id, score)``: the best few of each block for each query."""
    in_block = max(1, BLOCK_BYTES // (8 * len(codes.mean)))
    vector_blocks, query_blocks = -(-n_vectors // in_block), max(1, -(-n_queries // in_block))
    own = F.xxhash64("row")
    every = F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1)))
    left = queries.withColumn("q", F.pmod(own, F.lit(query_blocks)).cast("int")).withColumn("v", every)
    every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    right = vectors.withColumn("v", F.pmod(own, F.lit(vector_blocks)).cast("int")).withColumn("q", every)
    return left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(_search(codes, nearest, probing), FOUND)


def _of_length(rows: DataFrame, n_dims: int, n_rows: int, every: int, nearest: int) -> DataFrame:
    """What `nearest_vectors` finds among vectors of one length."""
    bound = max(LEAST_SAMPLE, min(SAMPLE_VECTORS, SAMPLE_BYTES // (8 * n_dims)))
    sample = rows
    if n_rows > bound:
        # A few more than the bound are let through, so that the limit leaves out few.
        let_through = int(1.2 * bound / n_rows * (1 << 30))
        sample = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < let_through).limit(bound)
    codes = fit_codes(_matrix(sample.select("vector").toArrow().column("vector")), nearest)
    queries = materialize(rows.filter(F.col("id") % every == 0), "queries")
    n_queries = queries.count()
    found = materialize(_found(queries, rows, n_queries, n_rows, codes, nearest, True), "found")
    enough = found.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(nearest, n_rows - 1))
    short = materialize(queries.join(enough, "row", "left_anti"), "queries")
    n_short = short.count()
    if not n_short:
        return found
    done = found.join(short, "row", "left_anti")
    return done.unionByName(_found(short, rows, n_short, n_rows, codes, nearest, False))


def nearest_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    every: int = 50,
    nearest: int = NEAREST,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest found of each query, by cosine.

    Queries are the rows whose id is divisible by ``every``; candidates are all other rows with a
    vector of the same length, each length with codes of its own.  Vectors that are null, zero, or
    hold a null or non-finite component take no part, nor do rows without an id.  Rows that share
    an id are queries and candidates each, with ranks of their own.  Ties go to the smaller id;
    equal vectors are candidates each.  A vector longer than a block is a block by itself.  Other
    columns are left out; an empty table gives no rows.
    """
    kind = vectors.schema[vector_column].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(
        vectors[id_column].cast("long").alias("id"), vectors[vector_column].cast(kind).alias("vector")
    )
    rows = rows.filter("id IS NOT NULL").filter(valid(F.col("vector")))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    found = rows.sparkSession.createDataFrame([], FOUND)
    for n_dims, n_rows in sorted(map(tuple, lengths.collect())):
        alike = rows.filter(F.size("vector") == n_dims)
        found = found.unionByName(_of_length(alike, n_dims, n_rows, every, nearest))
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")
