"""Vector code compression with partial-distance search.

Vectors become whole numbers and are cut into parts; each part position has a codebook, and a vector is kept as the
numbers of its parts' nearest entries.  Nearest entries are found by partial distances: dimensions are taken in
descending variance of the codebook, distances grow dimension by dimension, and an entry is dropped as soon as its sum
strictly exceeds the best complete distance known for that vector.  Masks do this for all vectors of a batch at once;
what is dropped is strictly worse, so ties and results are those of the full search.

Passes over the table assign parts batch by batch where the rows lie; a task sends only the sums and counts of each
entry.  The driver holds codebooks alone (entries times dimensions, whatever the table's size).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session_of, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are searched at once: bounds the masks of a batch.
_AT_ONCE = 4096


def nearest_entries(x, book):
    """(entry, squared distance) of the nearest row of ``book`` for each row of ``x``; ties to the lower entry. int64 arrays."""
    import numpy as np

    n, width = x.shape
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    first = order[0]
    sums = (x[:, first, None] - book[None, :, first]) ** 2
    guess = sums.argmin(axis=1)
    best = ((x - book[guess]) ** 2).sum(axis=1)
    rows, entries = np.nonzero(sums <= best[:, None])
    sums = sums[rows, entries]
    look = 2
    for done, dim in enumerate(order[1:], 2):
        sums += (x[rows, dim] - book[entries, dim]) ** 2
        if done == look and done < width:  # complete the entry that leads by now: a tighter bound for those that follow
            look *= 2
            at = _leaders(rows, sums)
            best[rows[at]] = np.minimum(best[rows[at]], ((x[rows[at]] - book[entries[at]]) ** 2).sum(axis=1))
        alive = sums <= best[rows]
        rows, entries, sums = rows[alive], entries[alive], sums[alive]
    at = _leaders(rows, sums)
    return entries[at], sums[at]


def _leaders(rows, sums):
    """Index of the least sum of each run of equal ``rows``, the first one of equal sums."""
    import numpy as np

    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    least = np.minimum.reduceat(sums, starts)
    hits = np.flatnonzero(sums == np.repeat(least, np.diff(np.append(starts, len(rows)))))
    return hits[np.concatenate(([True], rows[hits][1:] != rows[hits][:-1]))]


def _matrix(column, dim: int, scale: int):
    """An Arrow list column without nulls as whole numbers floor(scale * x)."""
    import numpy as np
    import pyarrow as pa

    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dim)


def _largest(width: int) -> int:
    """Whole numbers up to this have squared distances over ``width`` dimensions that fit 63 bits."""
    return int((2**62 / width) ** 0.5 / 2)


def usable(vectors: DataFrame, vector: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """Rows that take part, and the length of their vectors (0 if there are none)."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & sound)
    lengths = kept.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not lengths:
        return kept, 0
    dim = lengths[0]["n"]
    return kept.where((F.size(v) == dim) & F.forall(v, lambda x: F.abs(x) < _largest(dim // parts) // scale)), dim


def fit_codebooks(kept: DataFrame, dim: int, vec_id: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
    """Codebooks as an int64 array (part, entry, position): the first vectors by id, then ``rounds`` of assigning and averaging."""
    import numpy as np

    if not dim:
        return np.zeros((parts, 0, 0), np.int64)
    seeds = kept.select(vec_id, vector).orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).collect()
    first = np.floor(np.array([r[1] for r in seeds], np.float64).reshape(-1, dim) * scale).astype(np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), parts, dim // parts).swapaxes(0, 1))
    width = dim // parts
    small_batches(session_of(kept), _AT_ONCE)
    for _ in range(rounds):
        held = books

        def sums(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total, count = np.zeros(held.shape, np.int64), np.zeros(held.shape[:2], np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), dim, scale)
                for p in range(parts if len(x) else 0):
                    own = x[:, p * width : (p + 1) * width]
                    entry, _ = nearest_entries(own, held[p])
                    np.add.at(total[p], entry, own)
                    count[p] += np.bincount(entry, minlength=len(held[p]))
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        seen = kept.select(vector).mapInArrow(sums, "part long, entry long, n long, total array<long>")
        seen = seen.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = books.copy()
        for r in seen.collect():  # entries times dimensions at most
            books[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    return books


def _digits(books) -> int:
    return max(2, len(f"{max(books.shape[1] - 1, 0):x}"))


def encode_vectors(kept: DataFrame, books, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``kept`` with code and error in place of the vectors, which all have the codebooks' dimensions."""
    import numpy as np

    others = [c for c in kept.columns if c != vector]
    parts, count, width = books.shape
    digits = _digits(books)

    def coded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = np.array([f"{i:0{digits}x}" for i in range(count)], object)
        for batch in batches:
            x = _matrix(batch.column(len(others)), parts * width, scale) if batch.num_rows else np.empty((0, parts * width), np.int64)
            code, error = np.full(len(x), "", object), np.zeros(len(x), np.int64)
            for p in range(parts if len(x) else 0):
                entry, far = nearest_entries(x[:, p * width : (p + 1) * width], books[p])
                code += names[entry]
                error += far
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(error)], [*others, "code", "error"])

    small_batches(session_of(kept), _AT_ONCE)
    kinds = dict(kept.dtypes)
    return kept.select(*others, vector).mapInArrow(coded, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "code string", "error long"]))


def decode_codes(coded: DataFrame, books, code: str = "code", scale: int = SCALE) -> DataFrame:
    """``coded`` with a column decoded: the vector whose whole numbers are those of the code's entries (null for a null code)."""
    import numpy as np

    digits, names = _digits(books), coded.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        where = np.arange(len(books))
        for batch in batches:
            out = []
            for c in batch.column(names.index(code)).to_pylist():
                picked = None if c is None else [int(c[i : i + digits], 16) for i in range(0, len(c), digits)]
                out.append(None if picked is None else (books[where, picked].ravel() / scale).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*names, "decoded"])

    return coded.mapInArrow(run, coded.withColumn("decoded", F.array().cast("array<double>")).schema)


def compress_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """Rows (vec_id, label, code, error, label_error, codebooks_sha256) of the vectors that take part.

    code has two hex digits (more for over 256 entries) for each part; error is the squared distance of the whole numbers
    to their entries, label_error its sum over rows of equal label (nulls are equal).  Null vectors and those that hold null or non-finite
    components take no part, nor do vectors of a length that ``parts`` doesn't divide, of another length than most have,
    or with components so large that squared distances exceed 63 bits (beyond some 1 000 000 at the defaults).  With fewer
    rows than entries the codebooks have as many entries as there are rows.  Ties and repeated ids get a row each; null
    ids come last among the first vectors.  An empty table gives no rows.  Other columns are not read.
    """
    kept, dim = usable(vectors, vector, parts, scale)
    books = fit_codebooks(kept, dim, vec_id, vector, parts, entries, rounds, scale)
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = cut(encode_vectors(kept.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")), books, "vector", scale))
    # Spark splits the rows of a label that very many hold: both sides of the join are dealt for it.
    sums = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
