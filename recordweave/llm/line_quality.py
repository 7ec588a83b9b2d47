"""Quality rules by cross-document line frequency.

Lines are normalised and hashed.  For each host and line the distinct documents that hold it are counted over the whole
corpus; lines above the limit (navigation, licence notes, template text) are removed, and a document that loses most of
its words that way is rejected.  Base rules (word counts, symbols, repeats inside the document) come with it.

Copies of a document count as one document, so a group of copies doesn't condemn its own text; leaving one of them is
the task of deduplication.  Exact copies have one normalised content.  Near copies are told by 24 MinHash values of their
five-word shingles, where it matters: among the contents that hold a line above the limit.  A content's copies are as many
as share a value with it, at the 14th largest of 24 counts, so more than half of its shingles must be theirs; of n copies each
counts as one nth of a document.  That is a count by keys: no contents are compared, and no line's documents meet in one task.
The limit follows the host's size.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session_of, small_batches, text_bytes, unused
from .near_duplicates import Shingler

#: A host's line in more independent documents than this is removed; on hosts with more than 20 000 distinct contents, in more
#: than this share of them.  Both are parameters: a share of 0 holds every host to the number.
MAX_DOCUMENTS_PER_HOST, MAX_SHARE_OF_HOST = 20, 0.001
#: MinHash values of a content; copies are counted at this rank among them.  Of copies that are 0.8 like their original one in
#: 500 is missed (and counts as a document of its own), of those that are 0.85 like it one in ten thousand.
VALUES, RANK = 24, 14
#: A document counts in units of this size, so sums are exact.
_WHOLE = 1 << 32
#: A document is rejected when less than this share of its words is left.
LEAST_SHARE_LEFT = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_FIELDS = "doc_id {id}, host {host}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<long>, line_words array<int>, minima array<int>"
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(n for n in range(256) if n not in _SYMBOLS)


def normalised(line: bytes) -> bytes:
    """A line for comparison: words joined by one space, A-Z in lower case."""
    return b" ".join(line.lower().split())


def repeat_words(words: list) -> int:
    """Words inside 3-word windows that the text holds twice or more, the first included."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    size = len(ids)
    if size < 2_000_000:
        key = (w[:-2] * size + w[1:-1]) * size + w[2:]
    else:  # 64 bits can't hold three such numbers: number the pairs first
        pairs = np.unique(w[:-1] * size + w[1:], return_inverse=True)[1]
        key = pairs[:-1] * size + w[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def profile(text: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content hash, line hashes, words of each)."""
    from xxhash import xxh3_64_intdigest

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    words = text.split()
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogateescape"))
    seen: set[bytes] = set()
    held: dict[int, int] = {}
    again = 0
    content = []
    for line in text.split(b"\n"):
        if not (n := len(line.split())):
            continue
        again += line in seen
        seen.add(line)
        h = signed(xxh3_64_intdigest(normalised(line)))
        held[h] = held.get(h, 0) + n
        content.append(h)
    key = signed(xxh3_64_intdigest(repr(content).encode()))
    return len(words), chars, len(joined.translate(None, _NOT_SYMBOLS)), again, repeat_words(words), key, list(held), list(held.values())


def minima(shingler: Shingler, text: bytes):
    """The least value of each of the first hash functions over the text's shingles."""
    import numpy as np

    best, shingles = np.full(VALUES, 0xFFFFFFFF, np.uint32), shingler.shingles(text)
    for i in range(0, len(shingles), 4096):
        x = (shingles[i : i + 4096, None] * shingler.a[:VALUES] + shingler.b[:VALUES]) >> np.uint64(32)
        best = np.minimum(best, x.min(0).astype(np.uint32))
    return best.view(np.int32)


def document_lines(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One row per document: its base measures, content hash, distinct line hashes and their words."""
    small_batches(session_of(docs))
    kinds = dict(docs.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "lines", "line_words", "minima"]
        shingler = Shingler(5)
        for batch in batches:
            if batch.num_rows:
                texts = text_bytes(batch.column(2))
                columns = zip(*map(profile, texts), strict=True)
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                arrays.append(pa.array([minima(shingler, t) for t in texts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "host", *names])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _FIELDS.format(id=kinds[doc_id], host=kinds[host]))


def _frequent_lines(measured: DataFrame, max_documents: int, share: float) -> DataFrame:
    """(row, line, words) of every line of a document that is above the limit on the document's host.

    Small tables of keys are materialised before they are joined: a join then deals both sides, and Spark splits the rows
    of a key that very many documents hold, or broadcasts the keys after measuring them.
    """
    host_key = F.coalesce(F.concat(F.lit("h"), F.col("host").cast("string")), F.lit(""))
    measured = measured.withColumn("host", F.xxhash64(host_key))
    held = measured.select("row", "host", "content", F.explode(F.arrays_zip("lines", "line_words")).alias("line"))
    held = held.select("row", "host", "content", F.col("line.lines").alias("line"), F.col("line.line_words").alias("words"))
    contents = measured.where(F.size("lines") > 0).groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("contents"))
    tops = cut(contents.select("host", F.greatest(F.lit(max_documents), F.floor(F.col("contents") * share)).cast("long").alias("top")))
    counted = held.groupBy("host", "line", "content").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("one").alias("documents"))
    over = cut(counted.where(F.col("documents") > max_documents).join(tops, "host").where(F.col("documents") > F.col("top")).select("host", "line", "top"))
    hits = cut(held.join(over, ["host", "line"]).select("row", "host", "line", "words", "content", "top"))

    # Which of these lines do more independent documents hold.
    once = hits.groupBy("host", "content").agg(F.min("row").alias("row")).join(measured.select("row", "minima"), "row")
    values = once.select("host", "content", F.posexplode("minima").alias("at", "value"))
    crowds = cut(values.groupBy("host", "at", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    copies = values.join(crowds, ["host", "at", "value"]).groupBy("host", "content").agg(F.get(F.sort_array(F.collect_list("n"), False), F.lit(RANK - 1)).alias("copies"))
    copies = cut(copies.where("copies is not null"))
    each = hits.join(copies, ["host", "content"], "left").groupBy("host", "line", "content").agg(F.min("top").alias("top"), F.max(F.coalesce("copies", F.lit(1))).alias("copies"))
    documents = each.groupBy("host", "line").agg(F.sum(F.floor(F.lit(_WHOLE) / F.col("copies"))).alias("documents"), F.min("top").alias("top"))
    frequent = cut(documents.where(F.col("documents") > F.col("top") * _WHOLE).select("host", "line"))
    return hits.join(frequent, ["host", "line"]).select("row", "line", "words")


def _measured(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    return cut(document_lines(docs, doc_id, text, host).withColumn("row", F.monotonically_increasing_id()))


def _judged(measured: DataFrame, lost: DataFrame, least_left: float) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = measured.drop("content", "lines", "line_words", "minima").join(lost, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    out = out.withColumn("base_failed", failed).withColumn("share_left", F.when(F.col("n_words") > 0, 1 - F.col("n_removed_words") / F.col("n_words")).otherwise(0.0))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("share_left") >= least_left))


def line_quality(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_documents: int = MAX_DOCUMENTS_PER_HOST,
    least_left: float = LEAST_SHARE_LEFT,
    share: float = MAX_SHARE_OF_HOST,
) -> DataFrame:
    """Base measures and verdict of each row of ``docs``; columns n_removed_words and share_left tell what lines cost.

    A line is removed on a host where more than ``max_documents`` independent documents hold it, and more than ``share`` of
    the host's distinct contents; a document with less than ``least_left`` of its words left is rejected.

    Null or empty text: no words, so the base rules reject it.  A null host is a host of its own.  Repeated rows and
    null ids get a row each.  An empty table gives no rows.  Other columns are not read.
    """
    measured = _measured(docs, doc_id, text, host)
    lost = _frequent_lines(measured, max_documents, share).groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    out = _judged(measured, lost, least_left)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "share_left")


def without_lines(text: str, drop: list[int]) -> str:
    """The text without the lines whose hash is in ``drop``."""
    from xxhash import xxh3_64_intdigest

    gone = set(drop)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return "\n".join(x for x in text.split("\n") if not x.encode().split() or signed(xxh3_64_intdigest(normalised(x.encode()))) not in gone)


def clean_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_documents: int = MAX_DOCUMENTS_PER_HOST,
    least_left: float = LEAST_SHARE_LEFT,
    share: float = MAX_SHARE_OF_HOST,
) -> DataFrame:
    """``docs`` without the rejected documents, and the others without lines above the limit; all columns stay.

    n_chars, where there is one, follows the text.  Each row is judged as in ``line_quality``, whatever its id: a verdict
    follows from host and text alone, so it is joined by their hash.  Null or empty texts have no words and go.  Extra
    columns stay, whatever their names; an empty table stays empty.
    """
    key_name, of_name, drop_name = unused(docs, "__key", "__of", "__drop")
    host_key = F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit(""))
    keyed = F.md5(F.concat(F.length(host_key).cast("string"), F.lit(":"), host_key, F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    measured = _measured(docs.select(keyed.alias("key"), F.col(text).alias("text"), F.col(host).alias("host")), "key", "text", "host")
    lost = _frequent_lines(measured, max_documents, share).groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("drop"))
    kept = _judged(measured, lost, least_left).where("kept").groupBy("doc_id").agg(F.first("drop").alias(drop_name))
    # As binary on both sides: the join deals both anew, so Spark can split the rows of a text that very many hold.
    joined = docs.withColumn(of_name, F.unhex(keyed)).join(kept.select(F.unhex("doc_id").alias(key_name), drop_name), F.col(of_name) == F.col(key_name))
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            drops = batch.column(len(names)).to_pylist()
            texts = [without_lines(t, d) if t and d else t for t, d in zip(batch.column(at).to_pylist(), drops, strict=True)]
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.select(*names, drop_name).mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return out
