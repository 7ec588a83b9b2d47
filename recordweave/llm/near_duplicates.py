"""MinHash near-duplicates with sequential Bayesian verification.

1. Each document's distinct word shingles become 64-bit hashes, a key of the whole set and a MinHash signature.
2. Documents of equal sets form a class; only one representative of each goes on (any number of copies costs a row).
3. Banding proposes candidates.  In a bucket every member is first paired with one hub (the member that meets most
   others), never all members with all.
4. Candidates are verified sequentially: batch after batch of signature values is compared, and a pair is dropped as
   soon as the posterior probability of reaching the threshold is below the chosen miss probability.
5. Survivors are verified exactly, on full shingle sets.  Links make components.
6. Buckets that still hold several components get their cross-component pairs compared inside block tasks: by
   signatures, which leave the members that have a partner at all, then on the sets of those, likeliest first.  What is
   already connected is never compared, and a task returns links that join components, at most one less than its
   members: no group's pairs are ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session_of, small_batches, text_bytes
from .components import connected_components

BANDS, BAND_ROWS = 20, 4
SIGNATURE = 128
#: Signature values compared at a time, and the posterior probability below which a pair is dropped.
BATCH, MISS = 16, 1e-6
#: Members of a block when signatures of a bucket's components are compared; members and shingles of one when sets are;
#: pairs of a hub per verification task.
SIGNATURE_BLOCK, BLOCK, BLOCK_SHINGLES, HUB_PAIRS = 4096, 1024, 4 << 20, 512
PERCENT = 80


def least_matches(percent: int = PERCENT, miss: float = MISS, total: int = SIGNATURE, batch: int = BATCH) -> list[int]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior the similarity given m matches of n has a Beta(m + 1, n - m + 1) posterior; its mass above
    the threshold t is the chance that a Binomial(n + 1, t) variable is at most m.
    """
    t, out = percent / 100, []
    for n in range(batch, total + 1, batch):
        mass, m = 0.0, 0
        for m in range(n + 1):
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= miss:
                break
        out.append(m)
    return out


class Shingler:
    """Shingle sets and signatures of texts."""

    def __init__(self, size: int):
        import numpy as np

        self.size = size
        draw = np.random.default_rng(20_240_901)
        self.odd = draw.integers(0, 1 << 63, size + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        self.a = draw.integers(0, 1 << 63, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, SIGNATURE, np.uint64)
        self.words: dict[bytes, int] = {}

    def shingles(self, text: bytes):
        """Sorted distinct 64-bit hashes of the text's shingles: A-Z in lower case, words as in common.WORD."""
        import numpy as np
        from xxhash import xxh3_64_intdigest

        words = text.lower().split()
        known, n, k = self.words, len(words), self.size
        if not n:
            return np.empty(0, np.uint64)
        if len(known) > 100_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        width = min(n, k)  # fewer words than a shingle: the whole sequence is one
        x = h[: n - width + 1] * self.odd[0]
        for i in range(1, width):
            x = (x ^ (x >> np.uint64(29))) * self.odd[i] + h[i : n - width + 1 + i]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 if width == k else 0x94D049BB133111EB + 2 * width)
        x = (x ^ (x >> np.uint64(27))) * self.odd[k]
        return np.unique(x ^ (x >> np.uint64(31)))

    def signature(self, shingles) -> bytes:
        import numpy as np

        best = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(shingles), 4096):
            x = (shingles[i : i + 4096, None] * self.a + self.b) >> np.uint64(32)
            best = np.minimum(best, x.min(0).astype(np.uint32))
        return best.tobytes()


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, mark, text): the text's hash tells rows apart that share an id or have none."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))


def signatures(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, mark, n_shingles, key1, key2, signature) of every row."""
    small_batches(session_of(docs))
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        shingler = Shingler(size)
        for batch in batches:
            n, keys, signature = [], [], []
            for t in text_bytes(batch.column(2)):
                s = shingler.shingles(t)
                n.append(len(s))
                keys.append(xxh3_128_digest(s.tobytes()))
                signature.append(shingler.signature(s) if len(s) else None)
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(signature, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "n_shingles", "key1", "key2", "signature"])

    return _named(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, mark long, n_shingles long, key1 long, key2 long, signature binary")


def _bands(classes: DataFrame) -> DataFrame:
    width = 4 * BAND_ROWS
    keys = [F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)) for i in range(BANDS)]
    return classes.select("cid", F.posexplode(F.array(*keys)).alias("band", "bucket"))


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and the sequential test leave."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b", "sa", "sb")
    needed = least_matches(percent)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(n, SIGNATURE) for i in (2, 3))
            alive, matches = np.arange(n), np.zeros(n, np.int64)
            for i, least in enumerate(needed):
                part = slice(i * BATCH, (i + 1) * BATCH)
                matches = matches + (x[alive, part] == y[alive, part]).sum(1)
                stays = matches >= least
                alive, matches = alive[stays], matches[stays]
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _shingle_sets(wanted: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(cid, members): the packed shingle sets of the wanted classes (cid, doc_id, mark, key1, key2), made of the texts again."""
    wanted = wanted.select("cid", F.col("doc_id").alias("want"), F.col("mark").alias("marked"), "key1", "key2")
    texts = _named(docs, doc_id, text).join(wanted, F.col("doc_id").eqNullSafe(F.col("want")) & (F.col("mark") == F.col("marked"))).select("cid", "key1", "key2", "text")

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        shingler = Shingler(size)
        for batch in batches:
            cids, keys1, keys2 = (batch.column(i).to_pylist() for i in range(3))
            cid, packed = [], []
            for c, k1, k2, t in zip(cids, keys1, keys2, text_bytes(batch.column(3)), strict=True):
                s = shingler.shingles(t).tobytes()
                d = xxh3_128_digest(s)  # rows that share an id but not a text are told apart by their key
                if (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)) == (k1, k2):
                    cid.append(c)
                    packed.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(packed, pa.binary())], ["cid", "members"])

    return texts.mapInArrow(sets, "cid long, members binary").dropDuplicates(["cid"])


def linked(one, two, percent: int) -> bool:
    """Whether two sorted arrays of distinct hashes reach the threshold: 100 x intersection >= percent x union."""
    import numpy as np

    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among pairs of members with hubs, confirmed on full sets.

    Pairs are grouped by the member that is in most of them; its set goes once to each task that compares it, and a hub
    of very many pairs is spread over tasks.
    """
    often = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("pairs"))
    of = lambda x: often.select(F.col("cid").alias(x), F.col("pairs").alias(f"p{x}"))
    turned = pairs.join(of("a"), "a").join(of("b"), "b")
    swap = F.col("pb") > F.col("pa")
    turned = turned.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("cid"), F.greatest("pa", "pb").alias("pairs"))
    turned = cut(turned.withColumn("part", F.pmod(F.xxhash64("cid"), F.ceil(F.col("pairs") / HUB_PAIRS)).cast("int")).drop("pairs"))
    leaves = turned.join(sets, "cid").select("hub", "part", "cid", F.lit(1).alias("leaf"), "members")
    hubs = turned.select("hub", "part").distinct().join(sets, F.col("hub") == F.col("cid")).select("hub", "part", "cid", F.lit(0).alias("leaf"), "members")
    parts = session_of(pairs).conf.get("spark.sql.shuffle.partitions")
    dealt = hubs.unionByName(leaves).repartition(int(parts), "hub", "part").sortWithinPartitions("hub", "part", "leaf")

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = None
        for batch in batches:
            a, b = [], []
            for hub, _, cid, leaf, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(packed, np.uint64)
                if not leaf:
                    own = s
                elif linked(own, s, percent):
                    a.append(hub)
                    b.append(cid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cut(dealt.mapInArrow(compare, "a long, b long"))


def _in_block(group: tuple, needed: list[int], percent: int) -> Iterator:
    """(k, ys, matches): for each member k of a block pair the members ys of other components that the sequential test
    leaves; ``group`` holds the columns (bucket, i, j, block, band, cid, label, n_shingles, signature) of its members."""
    import numpy as np

    _, i, j, block, band, cid, label, n, sig = group[:9]
    sig = np.frombuffer(b"".join(sig), np.uint32).reshape(len(cid), SIGNATURE)
    cid, label, n, block = map(np.asarray, (cid, label, n, block))
    left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
    for k in left:
        y = right[cid[right] > cid[k]] if i[0] == j[0] else right
        y = y[(label[y] != label[k]) & (100 * np.minimum(n[y], n[k]) >= percent * np.maximum(n[y], n[k]))]
        # a pair that meets in several bands is compared in the first of them
        earlier = band[0] * BAND_ROWS
        if earlier and len(y):
            y = y[~(sig[y, :earlier] == sig[k, :earlier]).reshape(len(y), band[0], BAND_ROWS).all(2).any(1)]
        matches = np.zeros(len(y), np.int64)
        for b, least in enumerate(needed):
            part = slice(b * BATCH, (b + 1) * BATCH)
            matches = matches + (sig[y, part] == sig[k, part]).sum(1)
            stays = matches >= least
            y, matches = y[stays], matches[stays]
        yield k, y, matches


def _partnered(rows: list, needed: list[int], percent: int) -> list[tuple[int, int]]:
    """(bucket, cid) of a block pair's members that the sequential test leaves with a partner."""
    import numpy as np

    group = tuple(zip(*rows, strict=True))
    alive = np.zeros(len(rows), bool)
    for k, y, _ in _in_block(group, needed, percent):
        alive[y] = True
        alive[k] |= len(y) > 0
    return [(group[0][x], group[5][x]) for x in np.flatnonzero(alive)]


def _compare_block(rows: list, needed: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join components among a block pair's members; the last column holds their sets."""
    import numpy as np

    group = tuple(zip(*rows, strict=True))
    cid, label, members = group[5], group[6], group[9]
    found = [np.stack([matches, np.full(len(y), k), y], 1) for k, y, matches in _in_block(group, needed, percent)]
    found = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out, sets = [], {}
    for k, y in found[np.argsort(-found[:, 0], kind="stable"), 1:].tolist():
        a, b = root(int(label[k])), root(int(label[y]))
        if a == b:
            continue
        for x in (k, y):
            if x not in sets:
                sets[x] = np.frombuffer(members[x], np.uint64)
        if linked(sets[k], sets[y], percent):
            parent[max(a, b)] = min(a, b)
            out.append((int(cid[k]), int(cid[y])))
    return out


def _block_tasks(members: DataFrame, payload: DataFrame, blocks, work, names: list[str], percent: int) -> DataFrame:
    """``work`` on blocks of each bucket of ``members`` (bucket, band, cid, label, n_shingles) that holds several components.

    Members of the bucket's largest component are never compared with one another: their blocks only meet those of the
    other members, which meet each other as well.  So a large group of copies costs a pass for each block of strangers
    among it, not one for each two blocks of its own.  ``blocks`` gives the number of blocks for a condition on members;
    ``payload`` (cid and more) joins the dealt rows last.
    """
    needed = least_matches(percent)
    sizes = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("largest"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    # Written, so that Spark deals both sides of the joins by bucket and can split the rows of a large one.
    largest = cut(largest)
    sided = members.join(largest, "bucket").withColumn("stranger", F.col("label") != F.col("largest")).drop("largest")
    counts = cut(sided.groupBy("bucket").agg(F.greatest(blocks(~F.col("stranger")), F.lit(1)).cast("int").alias("own"), F.greatest(blocks(F.col("stranger")), F.lit(1)).cast("int").alias("strange")))
    dealt = sided.join(counts, "bucket")
    place = lambda n: F.pmod(F.xxhash64("cid", F.lit(7)), F.col(n)).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("stranger"), F.col("own") + place("strange")).otherwise(place("own")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(F.col("stranger"), F.lit(0)).otherwise(F.col("own")), F.col("own") + F.col("strange") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "cid", "label", "n_shingles")
    dealt = dealt.join(payload, "cid").select(*dealt.columns, *[c for c in payload.columns if c != "cid"])
    parts = session_of(members).conf.get("spark.sql.shuffle.partitions")
    dealt = dealt.repartition(int(parts), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def emit(pairs: list):
            return pa.RecordBatch.from_arrays([pa.array([p[x] for p in pairs], pa.int64()) for x in (0, 1)], names)

        group: list = []
        for batch in batches:
            found: list = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[-1][:3] != row[:3]:
                    found += work(group, needed, percent)
                    group = []
                group.append(row)
            yield emit(found)
        if group:
            yield emit(work(group, needed, percent))

    return dealt.mapInArrow(run, f"{names[0]} long, {names[1]} long")


def _cross_links(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside each bucket of ``members`` (bucket, band, cid, label, n_shingles).

    Signatures alone go round first, in large blocks: they tell which members have any partner that the sequential test
    leaves.  Only those are dealt again, with their sets, into blocks whose sets fit in a task.
    """
    signed = classes.select("cid", "signature")
    alive = _block_tasks(members, signed, lambda c: F.ceil(F.count_if(c) / SIGNATURE_BLOCK), _partnered, ["bucket", "cid"], percent)
    met = cut(members.join(alive.distinct(), ["bucket", "cid"]))
    small = lambda c: F.greatest(F.ceil(F.count_if(c) / BLOCK), F.ceil(F.sum(F.when(c, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES))
    return cut(_block_tasks(met, signed.join(sets, "cid"), small, _compare_block, ["a", "b"], percent))


def _order():
    """Which row stands for others: the smallest id (none comes last), then the smallest hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    component_id is the smallest doc_id that is reachable over links (similarity of full shingle sets at or above the
    threshold); kept marks the row(s) with that id.  Null, empty or blank text has no shingles and no links.  Rows that
    share an id each take part with their own text.  A null id takes part, but never names a component with others
    (nulls are passed over by the minimum).  An empty table gives no rows.  Other columns are not read.
    """
    out = _components(docs, doc_id, text, shingle, percent)
    component = F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component; all columns stay.

    It is the row of the smallest id (rows without an id come last), of these the one with the smallest hash of its text.
    Rows alike in id and text become one.  Null and blank texts are near nothing: they stay.  Extra columns may have any
    name; an empty table stays empty.
    """
    out = _components(docs, doc_id, text, shingle, percent)
    own = (F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    kept = out.where(own).select(F.col("doc_id").alias("id"), F.col("mark").alias("marked")).distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("marked")))
    return joined.dropDuplicates(["doc_id", "mark"]).select("row.*")


def _components(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, first): every row with the (none, doc_id, mark) that comes first in its component."""
    signed = cut(signatures(docs, doc_id, text, shingle))
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("key1", "key2").agg(F.min_by("mark", _order()).alias("mark"), F.min_by("doc_id", _order()).alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))

    bands = _bands(classes)  # cheaper to make twice than to store: twenty rows a class
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut(bands.join(buckets, "bucket"))
    degree = shared.groupBy("cid").agg(F.sum("size").alias("degree"))
    hubs = shared.join(degree, "cid").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("cid")).alias("order"))).alias("top")).select("bucket", (-F.col("top.order")).alias("hub"))
    star = shared.join(hubs, "bucket").where("cid <> hub").select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
    pairs = cut(_plausible(star, classes, percent))
    # Sets are made for documents of plausible pairs, and for those that meet others beside a hub.
    met = pairs.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(shared.where("size > 2").select("cid")).distinct()
    sets = cut(_shingle_sets(met.join(classes.select("cid", "doc_id", "mark", "key1", "key2"), "cid"), docs, doc_id, text, shingle))
    links = _star_links(pairs, sets, percent)

    # Each bucket's pairs with its hub are settled; what is left are members beside the hub, in different components.
    labels = connected_components(links)
    rest = shared.select("bucket", "band", "cid").join(hubs, "bucket").where("cid <> hub").drop("hub")
    rest = rest.join(labels, F.col("cid") == F.col("node"), "left").select("bucket", "band", "cid", F.coalesce("label", "cid").alias("label"))
    rest = cut(rest.join(classes.select("cid", "n_shingles"), "cid"))
    more = _cross_links(rest, classes, sets, percent)

    labels = connected_components(links.unionByName(more))
    named = classes.join(labels, F.col("cid") == F.col("node"), "left").select("key1", "key2", _order().alias("own"), F.coalesce("label", "cid").alias("label"))
    least = named.groupBy("label").agg(F.min("own").alias("first"))
    named = named.join(least, "label").select("key1", "key2", "first")
    return signed.drop("signature").join(named, ["key1", "key2"], "left").select("doc_id", "mark", "n_shingles", "first")
