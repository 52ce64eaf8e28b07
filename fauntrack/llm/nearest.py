"""Approximate maximum inner product by score-aware quantisation and exact reranking.

Codebooks of 16 entries per two dimensions are fitted on a bounded sample so
that the residual parallel to a vector weighs more than the orthogonal one
(the part of the error that moves inner products of likely matches). Every row
is encoded, four bits a subspace. Queries and rows meet in blocks: table scans
over the codes choose candidates, which are scored exactly on the original
vectors in double precision, and the best of all blocks are merged. Candidates
are the best of the scan and, whatever their number, every row whose score may
reach the last neighbour found among these: a scan is off by the product of the
query and the row's residual, and a row is left out only if that product would
have to be more than SPREADS times its spread over directions. Rows that the
codes do not tell apart are thus all scored.

Rows are shuffled once for every QUERIES_BLOCK queries, queries once for every
ROWS_BLOCK rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither as queries nor as candidates; vectors meet
those of their own dimension; ties go to the smaller vec_id; repeated rows are
rows of their own: each is a candidate, also for the others, each query row has
its own list of ranks, and none finds itself; a null vec_id takes no part; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks_for, hash_sample, materialise, table

#: Neighbours, divisor of query ids, rows of the fitting sample, candidates reranked per block at least.
NEIGHBOURS, QUERY_EVERY, SAMPLE, RERANK = 20, 20, 4096, 200
#: Rows of a block of the index and of a block of queries.
ROWS_BLOCK, QUERIES_BLOCK = 8192, 16384
#: A row is reranked if an error of so many times |query| |residual| / sqrt(dimension) would make it a neighbour.
SPREADS = 4.0
#: Share of a vector's norm from which scores matter; rounds of alternating optimisation.
THRESHOLD, ROUNDS = 0.2, 6
CODES, WIDTH = 16, 2


def parallel_weight(dimension: int, threshold: float = THRESHOLD) -> float:
    """How many times the parallel residual error weighs the orthogonal one."""
    return max(1.0, (dimension - 1) * threshold**2 / (1 - threshold**2))


def _subspaces(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    wide = -(-d // WIDTH) * WIDTH
    return np.pad(x, ((0, 0), (0, wide - d))).reshape(n, -1, WIDTH)


def encode(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 2, start: np.ndarray | None = None) -> np.ndarray:
    """Codes (rows x subspaces) by coordinate descent on the anisotropic error."""
    parts = _subspaces(x)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    m = parts.shape[1]
    # residuals of every code, their squares and their parts along the vector
    square = np.empty((m, len(x), CODES), np.float32)
    along = np.empty((m, len(x), CODES), np.float32)
    for k in range(m):
        r = parts[:, k, None, :] - books[k][None]
        square[k] = (r * r).sum(2)
        along[k] = (r * unit[:, k, None, :]).sum(2)
    codes = square.argmin(2).T if start is None else start
    codes = codes.copy()
    rows = np.arange(len(x))
    total = sum(along[k][rows, codes[:, k]] for k in range(m))
    for _ in range(rounds):
        for k in range(m):
            rest = total - along[k][rows, codes[:, k]]
            codes[:, k] = (square[k] + (weight - 1) * (rest[:, None] + along[k]) ** 2).argmin(1)
            total = rest + along[k][rows, codes[:, k]]
    return codes.astype(np.uint8)


def fit(sample: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Codebooks (subspaces x 16 x 2) of a sample."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float64)
    parts = _subspaces(x)
    m = parts.shape[1]
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    weight = parallel_weight(x.shape[1])
    books = np.stack([parts[rng.choice(len(x), CODES, replace=len(x) < CODES), k] for k in range(m)])
    for k in range(m):  # plain k-means first
        for _ in range(8):
            near = ((parts[:, k, None] - books[k][None]) ** 2).sum(2).argmin(1)
            n = np.bincount(near, minlength=CODES)
            for j in range(WIDTH):
                mean = np.bincount(near, parts[:, k, j], CODES) / np.maximum(n, 1)
                books[k, :, j] = np.where(n > 0, mean, books[k, :, j])
    codes = None
    rows = np.arange(len(x))
    for _ in range(rounds):
        codes = encode(x, books, weight, 1, codes)
        along = np.stack([((parts[:, k] - books[k][codes[:, k]]) * unit[:, k]).sum(1) for k in range(m)], axis=1)
        total = along.sum(1)
        for k in range(m):  # least squares of each code, the others fixed
            rest, u = total - along[:, k], unit[:, k]
            a = np.eye(WIDTH)[None] + (weight - 1) * u[:, :, None] * u[:, None, :]
            b = np.einsum("nij,nj->ni", a, parts[:, k]) + (weight - 1) * rest[:, None] * u
            for c in range(CODES):
                own = codes[:, k] == c
                if own.any():
                    books[k, c] = np.linalg.lstsq(a[own].sum(0), b[own].sum(0), rcond=None)[0]
            along[:, k] = ((parts[:, k] - books[k][codes[:, k]]) * u).sum(1)
            total = rest + along[:, k]
    return books.astype(np.float32)


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries x rows) from tables of 16 entries; two tables are read as one of 256."""
    parts = _subspaces(queries.astype(np.float32))
    tables = np.einsum("qmd,mcd->mqc", parts, books)
    if len(tables) % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:1])])
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
    out = np.zeros((len(queries), len(codes)), np.float32)
    for k in range(0, len(tables), 2):
        both = (tables[k][:, :, None] + tables[k + 1][:, None, :]).reshape(len(queries), -1)
        out += both[:, codes[:, k].astype(np.int64) * CODES + codes[:, k + 1]]
    return out


def _pick(scores: np.ndarray, most: int) -> np.ndarray:
    """The `most` best rows, the first ones among equals."""
    if len(scores) <= most:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - most)[len(scores) - most]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: most - len(above)]])


_FOUND = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _vectors(rows: pa.Table, name: str) -> np.ndarray:
    column = rows.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def residual_norms(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Length of what the codes of every row leave out."""
    left = sum(((part - book[code]) ** 2).sum(1) for part, book, code in zip(_subspaces(x).transpose(1, 0, 2), books, codes.T, strict=True))
    return np.sqrt(left)


def candidates(approx: np.ndarray, reach: np.ndarray, exact, own: np.ndarray, neighbours: int, rerank: int) -> np.ndarray:
    """Rows to score exactly: the best of the scan, and all that may reach the last neighbour among them.

    reach is how far the scan of each row may be off, exact(rows) gives true
    scores, own marks rows that are no candidates.
    """
    at = _pick(np.where(own, -np.inf, approx), rerank)
    at = at[~own[at]]
    if len(at) < neighbours:
        return np.flatnonzero(~own)
    last = np.partition(exact(at), len(at) - neighbours)[len(at) - neighbours]
    more = (approx + reach >= last) & ~own
    more[at] = True
    return np.flatnonzero(more)


def _search(books: np.ndarray, neighbours: int, rerank: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        order = [("vec_id", "ascending"), ("row", "ascending")]
        rows, queries = rows.sort_by(order), queries.sort_by(order)
        x, q = _vectors(rows, "v"), _vectors(queries, "v")
        ids, row = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
        asked, own = queries.column("vec_id").to_numpy(), queries.column("row").to_numpy()
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        codes = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(ids), -1)[:, : books.shape[0]]
        reach = residual_norms(x, codes, books) * (SPREADS / np.sqrt(x.shape[1]))
        out: list[tuple] = []
        for s in range(0, len(asked), 64):
            approx = scan(q[s : s + 64], codes, books)
            for k in range(len(approx)):
                one = q[s + k]
                at = candidates(approx[k], reach * np.linalg.norm(one), lambda r, one=one: x[r] @ one, row == own[s + k], neighbours, rerank)
                score = x[at] @ one
                best = np.lexsort((row[at], ids[at], -score))[:neighbours]
                out.append((np.full(len(best), asked[s + k]), np.full(len(best), own[s + k]), ids[at][best], score[best]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=_FOUND)

    return run


def _encode_rows(books: np.ndarray):
    weight = parallel_weight(books.shape[0] * WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                codes = encode(_vectors(pa.Table.from_batches([part]), "v"), books, weight)
                if codes.shape[1] % 2:
                    codes = np.pad(codes, ((0, 0), (0, 1)))
                packed = (codes[:, ::2] << 4) | codes[:, 1::2]
                yield pa.record_batch([part.column("vec_id"), part.column("row"), part.column("v"), pa.array([c.tobytes() for c in packed], pa.binary())], names=["vec_id", "row", "v", "code"])

    return run


def _search_alike(v: DataFrame, n: int, n_queries: int, query_every: int, neighbours: int) -> DataFrame:
    """The nearest rows among vectors of one dimension."""
    sample = hash_sample(v, ["vec_id"], SAMPLE, n).select("v").collect()  # bounded by 2 * SAMPLE
    if not sample:
        sample = v.select("v").limit(SAMPLE).collect()
    books = fit(np.array([r["v"] for r in sample]))
    row_blocks, query_blocks = blocks_for(n, ROWS_BLOCK), blocks_for(n_queries, QUERIES_BLOCK)
    # written once: both sides read the same rows under the same numbers
    coded = materialise(v.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_encode_rows(books), "vec_id long, row long, v array<double>, code binary"), "codes")
    to = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    own = lambda k: F.pmod(F.xxhash64("row"), F.lit(k))
    rows = coded.withColumns({"rb": own(row_blocks), "qb": to(query_blocks)})
    queries = coded.where(F.col("vec_id") % query_every == 0).drop("code").withColumns({"qb": own(query_blocks), "rb": to(row_blocks)})
    found = rows.groupBy("rb", "qb").cogroup(queries.groupBy("rb", "qb")).applyInArrow(_search(books, neighbours, RERANK), "query_id long, query_row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, query_every: int = QUERY_EVERY, neighbours: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest rows found for every row whose vec_id is divisible by query_every."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0.0))
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % query_every == 0).alias("q")).orderBy("d").collect()
    # inner products are between vectors of one dimension: each dimension has its own index
    parts = [_search_alike(v.where(F.size("v") == r["d"]), r["n"], r["q"], query_every, neighbours) for r in sizes if r["n"] > 1 and r["q"]]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, parts)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector by inner product."""
    return search(table(spark, sf_dir, "embeddings"))
