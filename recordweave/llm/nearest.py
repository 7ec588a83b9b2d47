"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are scaled to length one and assigned to the nearest of a few centroids (fitted on a bounded sample).  What is
left of a vector beside its centroid is rotated at random; the signs of the result, packed, and three scalars are its
code.  For a query the inner products with all codes of a cell are estimated from the packed bits by table look-ups,
with an error bound; only vectors whose upper bound reaches the best lower bounds are reranked on original vectors.

Cells are split into blocks of bounded size, queries of a cell too, so a very common vector makes more blocks, not
larger ones.  A vector is sent once for each lane of queries, a query once for each block that it looks into, in the
precision that the table has; blocks and lanes are as large as memory allows, so both are few.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session_of

#: Rows that centroids are fitted on at most (a documented bound; every row is indexed).
SAMPLE = 20_000
#: Cells at most, and of all cells the share (and the least number) that a query looks into.
MOST_CELLS, PROBE_SHARE, LEAST_PROBES = 4096, 0.7, 8
#: Bytes of the vectors of a block, and queries of a lane.
BLOCK_BYTES, QUERIES = 16 << 20, 8192
#: Standard errors of the bound of an estimate.
ERRORS = 3.0


class Codes:
    """Centroids, rotation and the two directions of coding."""

    def __init__(self, centroids, seed: int = 5):
        """Made anew on each worker from the centroids alone: an object would need this library on executors."""
        import numpy as np

        self.centroids = centroids
        self.d = centroids.shape[1]
        self.padded = -(-self.d // 8) * 8
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.padded, self.padded)))
        self.rotation = (q * np.sign(np.diag(r)))[:, : self.d]

    def rotated(self, x):
        return x @ self.rotation.T

    def assign(self, unit):
        return (unit @ self.centroids.T - 0.5 * (self.centroids**2).sum(1)).argmax(1)

    def encode(self, unit, cell):
        """(packed signs, length of the residual, <code, residual direction>, <x, centroid>)."""
        import numpy as np

        centre = self.centroids[cell]
        rest = unit - centre
        length = np.sqrt((rest**2).sum(1))
        turned = self.rotated(rest / np.where(length > 0, length, 1)[:, None])
        bits = turned > 0
        agree = np.abs(turned).sum(1) / np.sqrt(self.padded)
        return np.packbits(bits, axis=1), length, np.where(agree > 0, agree, 1.0), (unit * centre).sum(1)

    def estimates(self, queries, cell: int, packed, length, agree, with_centre):
        """Estimated cosines (queries x codes) with a block of codes of one cell, and their error bounds."""
        import numpy as np

        centre = self.centroids[cell]
        rest = queries - centre
        far = np.sqrt((rest**2).sum(1))
        turned = self.rotated(rest / np.where(far > 0, far, 1)[:, None]).reshape(len(queries), -1, 8)
        signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0
        tables = turned @ signs.T  # for each query and byte of the code, the sums of all 256 byte values
        inner = np.zeros((len(queries), len(packed)))
        for byte in range(packed.shape[1]):
            inner += tables[:, byte, packed[:, byte]]
        scale = far[:, None] * length
        estimate = scale * (inner / np.sqrt(self.padded) / agree)
        error = scale * (np.sqrt(np.maximum(1 - agree**2, 0)) / agree * ERRORS / np.sqrt(max(self.padded - 1, 1)))
        return estimate + with_centre + (queries @ centre)[:, None] - centre @ centre, error


def fit_centroids(unit, cells: int, rounds: int = 8, seed: int = 3):
    """Centroids of unit vectors by Lloyd's rounds; an empty cell keeps its centroid."""
    import numpy as np

    centroids = unit[np.random.default_rng(seed).choice(len(unit), cells, replace=False)].copy()
    for _ in range(rounds):
        half = 0.5 * (centroids**2).sum(1)
        near = np.concatenate([(unit[i : i + 2048] @ centroids.T - half).argmax(1) for i in range(0, len(unit), 2048)])
        for k in range(unit.shape[1]):
            sums = np.bincount(near, unit[:, k], cells)
            counts = np.bincount(near, minlength=cells)
            centroids[:, k] = np.where(counts > 0, sums / np.maximum(counts, 1), centroids[:, k])
    return centroids


def _matrix(column, rows: int):
    """An Arrow column of equally long lists as doubles."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def cosines(query, vectors):
    """Cosines in double precision; each row is reduced alone, so equal vectors get equal values."""
    import numpy as np

    return (vectors * query).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum()))


def nearest_neighbours(
    vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, probe_share: float = PROBE_SHARE, most_cells: int = MOST_CELLS, sample_rows: int = SAMPLE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row with ``is_query`` its k nearest among all other rows.

    Centroids are fitted on ``sample_rows`` rows (every row is indexed), a query looks into ``probe_share`` of the cells.
    Nearest is the largest cosine, ties go to the smaller id.  Fewer than k candidates: all of them.  Vectors that are
    null, zero, empty, of another length than most of the sample, or that hold null or non-finite components take no
    part.  Results name ids, so of the rows of one id the one with the smallest vector takes part (as a query where any of
    them is one), and rows without an id don't.  An empty table gives no rows.  Other columns are not read.
    """
    import numpy as np

    spark = session_of(vectors)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    e = F.col("embedding")
    kind = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("query"))
    finite = F.forall(e, lambda x: F.coalesce((x - x) == 0, F.lit(False))) & F.exists(e, lambda x: x != 0)
    rows = rows.where("vec_id is not null and embedding is not null").where(finite).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("query").alias("query"))
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == length["d"])
    sample = rows.select(F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    unit = np.stack(sample["embedding"].to_numpy())
    unit = unit / np.sqrt((unit**2).sum(1))[:, None]
    cells = int(max(1, min(most_cells, len(unit) // 4, round(np.sqrt(length["count"]) / 2))))
    shared = spark.sparkContext.broadcast(fit_centroids(unit, cells))

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codes = Codes(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), batch.num_rows)
            biggest = np.abs(x).max(1)[:, None]
            scaled = x / biggest  # no overflow in the squares
            u = scaled / np.sqrt((scaled**2).sum(1))[:, None]
            cell = codes.assign(u)
            packed, length, agree, with_centre = codes.encode(u, cell)
            arrays = [pa.array(cell.astype(np.int32)), pa.array([p.tobytes() for p in packed], pa.binary()), *map(pa.array, (length, agree, with_centre))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *arrays], ["vec_id", "embedding", "query", "cell", "code", "length", "agree", "with_centre"])

    coded = cut(rows.mapInArrow(encode, f"vec_id long, embedding {kind}, query boolean, cell int, code binary, length double, agree double, with_centre double"))
    counts = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}  # one row per cell, at most most_cells
    sizes = np.array([counts.get(c, 0) for c in range(cells)])
    blocks = np.maximum(1, -(-sizes // max(1, block_bytes // (8 * length["d"]))))
    probes = max(LEAST_PROBES, int(np.ceil(cells * probe_share)))
    most_queries = coded.where("query").count()
    lanes = max(1, -(-most_queries // QUERIES))
    plan = spark.sparkContext.broadcast((sizes, blocks))

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codes, (sizes, blocks) = Codes(shared.value), plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), batch.num_rows)
            order = np.argsort(-(x / np.sqrt((x**2).sum(1))[:, None] @ codes.centroids.T - 0.5 * (codes.centroids**2).sum(1)), 1)
            seen = np.cumsum(sizes[order], 1)
            query, cell, block = [], [], []
            for i in range(batch.num_rows):
                n = max(probes, int(np.searchsorted(seen[i], k + 1)) + 1)  # cells enough for k other vectors
                for c in order[i, :n]:
                    for b in range(blocks[c] if sizes[c] else 0):
                        query.append(i)
                        cell.append(c)
                        block.append(b)
            take = pa.array(query, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cell, pa.int32()), pa.array(block, pa.int32())], ["vec_id", "embedding", "cell", "block"])

    queries = coded.where("query").select("vec_id", "embedding").mapInArrow(probe, f"vec_id long, embedding {kind}, cell int, block int")
    queries = queries.withColumn("lane", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lanes)).cast("int"))
    of_cell = F.get(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell")) if cells <= 64 else None
    numbers = spark.createDataFrame([(c, int(b)) for c, b in enumerate(blocks)], "cell int, blocks int")
    base = coded.withColumn("blocks", of_cell) if of_cell is not None else coded.join(F.broadcast(numbers), "cell")
    base = base.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("blocks")).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    base = base.select("cell", "block", "lane", "vec_id", "embedding", "code", "length", "agree", "with_centre")

    made: list[Codes] = []  # one for each task

    def search(key, left, right):
        import pyarrow as pa

        if not made:
            made.append(Codes(shared.value))
        codes, cell = made[0], key[0].as_py()
        out: list = []
        if left.num_rows and right.num_rows:
            matrix = lambda t: _matrix(t.column("embedding").combine_chunks(), t.num_rows)
            qid, q, vid, v = left.column("vec_id").to_numpy(), matrix(left), right.column("vec_id").to_numpy(), matrix(right)
            packed = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(vid), -1)
            length, agree, with_centre = (right.column(c).to_numpy() for c in ("length", "agree", "with_centre"))
            unit = q / np.sqrt((q**2).sum(1))[:, None]
            for begin in range(0, len(qid), 64):
                estimate, error = codes.estimates(unit[begin : begin + 64], cell, packed, length, agree, with_centre)
                for i in range(len(estimate)):
                    low, own = estimate[i] - error[i], vid != qid[begin + i]
                    low[~own] = -np.inf
                    n = min(k, int(own.sum()))
                    if not n:
                        continue
                    bar = np.partition(low, len(low) - n)[len(low) - n]
                    maybe = np.flatnonzero(own & (estimate[i] + error[i] >= bar))
                    score = cosines(q[begin + i], v[maybe])
                    best = np.lexsort((vid[maybe], -score))[:k]
                    out += [(qid[begin + i], vid[maybe[j]], score[j]) for j in best]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    key = ("cell", "block", "lane")
    near = queries.groupBy(*key).cogroup(base.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
