"""Nearest neighbours by cosine: anisotropic quantisation, four-bit table scans, exact reranking.

Vectors of length one turn the largest cosine into a maximum inner product. A vector is cut into subspaces of two
components, each coded by one of 16 codewords: four bits. For high inner products the part of the residual that is
parallel to the vector matters most, so the loss weighs it ETA times as much as the orthogonal part, which couples the
subspaces: codes are chosen by coordinate descent, codebooks by least squares given the codes. Codebooks are fitted on a
bounded sample; every vector is coded, in an index that is written once.

A search takes queries in blocks that are broadcast, and each task scans the codes of its vectors: the inner products of a
query's subspaces with the codewords make a table for each byte (two subspaces), and a code's score is a sum of lookups.
Reranking has no cap: a task keeps each query's k-th best exact score so far and compares exactly every vector whose
estimate comes within MARGIN standard errors of it (the error of estimates is measured on the sample). A task returns its
best k for each query, and Spark keeps the best of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.llm.common import written
from gatework.llm.vectors import finite, matrix, numeric

#: Components of a subspace and codewords in each: half a byte.
PART, CODES = 2, 16
#: Inner products above it (of vectors of length one) are what the loss is for; it gives ETA.
THRESHOLD = 0.2
#: Rows, about, of the sample that codebooks are fitted on, rounds of the fit, and sweeps of coordinate descent.
SAMPLE, ROUNDS, SWEEPS = 10_000, 5, 1
#: Standard errors of an estimate within which a vector is compared exactly.
MARGIN = 3.5
#: Queries broadcast at once, and queries and codes that are scored at once.
QUERY_BLOCK, QUERIES_AT_ONCE, CODES_AT_ONCE = 1 << 16, 64, 1 << 13
#: Nearest returned, and the queries: ids divisible by it.
K, EVERY = 5, 50


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one. A power of two comes out first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a and b, in double precision: equal vectors get equal values, whatever stands beside them."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None]) for x in (a.astype(np.float64), b.astype(np.float64)))
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


class Codebook:
    """`words[m]` are the codewords of subspace m, `error` the standard error of estimated inner products."""

    def __init__(self, sample: np.ndarray):
        x = self.parts(unit(sample))
        n, m, _ = x.shape
        dim = sample.shape[1]
        #: Weight of the parallel part of a residual, from the threshold and the dimension.
        self.eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        rng = np.random.default_rng(11)
        self.words = np.stack([x[rng.choice(n, CODES, replace=n < CODES), j] for j in range(m)])
        for _ in range(ROUNDS):
            codes = self.encoded(x)
            chosen = self.words[np.arange(m), codes]
            along = ((x - chosen) * x).sum(2)  # each subspace's part of <residual, x>
            for j in range(m):
                rest = along.sum(1) - along[:, j] + (x[:, j] ** 2).sum(1)  # <residual, x> is rest - <codeword, x_j>
                for c in range(CODES):
                    own = codes[:, j] == c
                    if own.any():
                        xs, w = x[own, j], self.eta - 1
                        self.words[j, c] = np.linalg.solve(own.sum() * np.eye(PART) + w * xs.T @ xs, (xs * (1 + w * rest[own])[:, None]).sum(0))
                along[:, j] = ((x[:, j] - self.words[j, codes[:, j]]) * x[:, j]).sum(1)
        residual = (x - self.words[np.arange(m), self.encoded(x)]).reshape(n, -1)
        # a query is as likely as a row of the sample: the residual's inner products with other rows
        others = residual[rng.permutation(n)[:2000]] @ x.reshape(n, -1)[rng.permutation(n)[:2000]].T
        self.error = float(np.sqrt((others**2).mean())) if n else 0.0

    @staticmethod
    def parts(x: np.ndarray) -> np.ndarray:
        """Rows cut into subspaces; an even number of them, filled up with zeros."""
        return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * PART)))).reshape(len(x), -1, PART)

    def encoded(self, x: np.ndarray) -> np.ndarray:
        """The codes of rows in parts, a byte each: nearest codewords first, then coordinate descent on the whole loss."""
        n, m, _ = x.shape
        codes = np.empty((n, m), np.uint8)
        along = np.empty((n, m))
        squares, lengths, all_ = (x * x).sum(2), (self.words**2).sum(2), np.arange(n)
        for sweep in range(1 + SWEEPS):
            total = along.sum(1) if sweep else None
            for j in range(m):
                dots = x[:, j] @ self.words[j].T
                loss = lengths[j] - 2 * dots  # less |x_j|^2, the same for all codewords
                if sweep:
                    rest = total - along[:, j]
                    parallel = (rest + squares[:, j])[:, None] - dots
                    parallel *= parallel
                    loss += (self.eta - 1) * parallel
                codes[:, j] = best = loss.argmin(1)
                new = squares[:, j] - dots[all_, best]
                total = rest + new if sweep else None
                along[:, j] = new
        return codes

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        codes = self.encoded(self.parts(unit(vectors)))
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each byte of a code and each of its 256 values: the inner products with all queries (of length one)."""
        inner = np.einsum("qmp,mcp->mcq", self.parts(queries), self.words)
        return (inner[1::2, :, None, :] + inner[::2, None, :, :]).reshape(len(inner) // 2, CODES * CODES, -1).astype(np.float32)


class Best:
    """The best k rows so far of each of some queries: exact scores, ids and rows, in no order."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), -np.inf)
        self.ids, self.rows = np.zeros((n, k), np.int64), np.full((n, k), -1)

    def floor(self) -> np.ndarray:
        return self.scores.min(1)

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Pairs of query number and row; of equal scores the smaller id stays, then the smaller row."""
        some, at = np.unique(query, return_inverse=True)
        k = self.scores.shape[1]
        q = np.concatenate([np.repeat(np.arange(len(some)), k), at])
        s, i, r = (np.concatenate([old[some].ravel(), new]) for old, new in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((r, i, -s, q))
        first = order[(np.searchsorted(q[order], np.arange(len(some)))[:, None] + np.arange(k)).ravel()]
        for old, new in ((self.scores, s), (self.ids, i), (self.rows, r)):
            old[some] = new[first].reshape(-1, k)


def scanned(book: Codebook, queries: np.ndarray, query_rows: np.ndarray, batches, k: int) -> Best:
    """The best k of batches (vectors, codes, ids, rows) for each query. A query's own row is no candidate."""
    best = Best(len(queries), k)
    lengths = unit(queries)
    margin = MARGIN * book.error
    for vectors, codes, ids, rows in batches:
        for a in range(0, len(queries), QUERIES_AT_ONCE):
            some = slice(a, a + QUERIES_AT_ONCE)
            tables = book.tables(lengths[some])
            for b in range(0, len(codes), CODES_AT_ONCE):
                part = codes[b : b + CODES_AT_ONCE]
                estimate = tables[0][part[:, 0]]
                for j in range(1, part.shape[1]):
                    estimate += tables[j][part[:, j]]
                # first the k best estimates, which raise the floor; then all that come near it
                for first in (True, False):
                    floor = best.floor()[some]
                    if first:
                        if not np.isinf(floor).any():
                            continue
                        v, q = np.argpartition(-estimate, min(k, len(part) - 1), axis=0)[: k + 1], np.arange(estimate.shape[1])
                        v, q = v.ravel(), np.tile(q, len(v))
                    else:
                        v, q = np.nonzero(estimate >= (floor - margin).astype(np.float32))
                    v, q = v + b, q + a
                    own = rows[v] == query_rows[q]
                    new = ~own if first else ~own & ~(best.rows[q] == rows[v][:, None]).any(1)
                    v, q = v[new], q[new]
                    for c in range(0, len(v), 1 << 16):
                        vs, qs = v[c : c + (1 << 16)], q[c : c + (1 << 16)]
                        exact = cosines(queries[qs], vectors[vs])
                        good = exact >= best.floor()[qs]
                        best.add(qs[good], exact[good], ids[vs[good]], rows[vs[good]])
    return best


def index(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, Codebook | None, int]:
    """The written index (row, vec_id, v, code) of all vectors that take part, its codebook, and their length."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), numeric(vectors, vector_col).alias("v"))
    rows = rows.where(finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").limit(1).collect()
    if not sizes:
        return rows, None, 0
    dim, count = sizes[0]
    rows = rows.where(F.size("v") == dim)
    # a share of rows by hash, so that reruns agree; twice the expected number bounds what comes to the driver
    share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / count) * (1 << 30))
    sample = rows.where(share).select("v").limit(2 * SAMPLE).collect()
    book = Codebook(np.array([r.v for r in sample]).reshape(-1, dim)) if sample else None
    if book is None:
        sample = rows.select("v").limit(SAMPLE).collect()
        book = Codebook(np.array([r.v for r in sample]).reshape(-1, dim))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = book.packed(matrix(batch.column("v"), dim))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "v", "code"])

    kind = dict(rows.dtypes)["v"]
    coded = rows.mapInArrow(run, f"vec_id long, v {kind}, code binary")
    return written(coded.withColumn("row", F.monotonically_increasing_id()), "vectors"), book, dim


#: What a null id counts as: it comes last among ties.
LAST = np.iinfo(np.int64).max
FOUND = "query_row long, query_id long, vec_id long, row long, score double"


def scan(rows: DataFrame, book: Codebook, dim: int, queries: pa.Table, k: int) -> DataFrame:
    """Each task's best k of its rows for each of the queries."""
    asked = (matrix(queries.column("v").combine_chunks(), dim), queries.column("row").to_numpy(), queries.column("vec_id").to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((book, asked))

    def run(batches):
        book, (vectors, query_rows, query_ids) = shared.value

        def parts():
            for batch in batches:
                if batch.num_rows:
                    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    yield matrix(batch.column("v"), dim), codes, batch.column("vec_id").fill_null(LAST).to_numpy(), batch.column("row").to_numpy()

        best = scanned(book, vectors, query_rows, parts(), k)
        q, at = np.nonzero(best.rows >= 0)
        ids = best.ids[q, at]
        columns = [pa.array(query_rows[q]), pa.array(query_ids[q]), pa.array(ids, mask=ids == LAST), pa.array(best.rows[q, at]), pa.array(best.scores[q, at])]
        out = pa.Table.from_arrays(columns, [f.split()[0] for f in FOUND.split(", ")])
        yield from out.to_batches(max_chunksize=100_000)

    return rows.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k other rows of the largest cosine
    found (all, if fewer), nearest first, ties to the smaller id.

    The cosine is exact (double precision, original vectors); which rows are found rests on estimates, so now and then a
    neighbour is missed. Null vectors, those of zeros or with a null or non-finite component, and those of another length
    than most take no part. Repeated rows and ids count each: a query's own row alone is left out. A row with a null id is no
    query, and comes last among ties. An empty table gives an empty result. Extra columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows, book, dim = index(vectors, id_col, vector_col)
    found = spark.createDataFrame([], FOUND)
    if book is not None:
        queries = rows.where(F.col("vec_id") % every == 0)
        most = max(1, min(QUERY_BLOCK, (QUERY_BLOCK * 64) // dim))
        blocks = -(-queries.count() // most)
        for b in range(blocks):
            block = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "vec_id", "v").toArrow()
            if block.num_rows:
                found = found.unionByName(written(scan(rows, book, dim, block, k), "nearest"))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
