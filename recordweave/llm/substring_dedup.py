"""Exact substring deduplication by prefix-free parsing.

Rolling-hash triggers parse every text into phrases (see phrases.py); neighbours overlap by MATCH - 1 bytes.  The distinct
phrases are the dictionary; the parse of a document is its sequence of phrases.  As in any prefix-free parsing, the order
of the corpus' suffixes follows from two smaller ones: suffixes of dictionary phrases, and suffixes of the parse where
dictionary suffixes are equal.  Every suffix of the corpus has its first MATCH bytes inside one phrase, and only whether
MATCH bytes agree matters here, so both are needed to a depth only:

* the parse is ordered by phrase, then document (its suffixes to the depth of one phrase): the first entry of a phrase is
  the first document that holds it, and a later document that holds it too repeats it from end to end;
* the suffix array of the dictionary is ordered by bytes to the depth of MATCH.  It falls apart by trigger, since equal
  suffixes lie under equal triggers, and triggers with one phrase, or one document, need none.  Each distinct phrase
  enters once, whatever the number of documents that hold it, which makes highly repetitive text cheap.

Combined, the corpus order is that of dictionary suffixes, each with the parse's entries of its phrase: a run of suffixes
that agree on MATCH bytes has its first document at its head, and what other documents hold of the run goes.

Verdicts go back to documents by phrase; a document parses its text again to place them.  Strings that would be the
trigger of very many phrases are found on a sample and demoted, so no trigger gathers a share of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session_of, small_batches, text_bytes
from .phrases import MATCH, Parser, suffixes_of

#: Text bytes whose phrases share a bucket (about 1.2 million records, some 40 MB in a worker).
BUCKET_BYTES = 20 << 20
#: Text bytes parsed at a time; a longer text is parsed alone, in pieces.
CHUNK = 1 << 19
#: Documents (about so many at least, and of all the share) whose phrases show common triggers, the distinct phrases there
#: that make a trigger common, and the most triggers that are demoted (those of most phrases).  Any choice gives the same
#: result; it only deals the work.
SAMPLE, SAMPLE_SHARE, COMMON, MOST_COMMON = 4_000, 0.0005, 20, 10_000


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def common_triggers(rows: DataFrame, total_rows: int) -> list[int]:
    """Triggers of very many distinct phrases in a sample of documents, as signed numbers (a bounded list)."""
    share = max(SAMPLE_SHARE, min(1.0, SAMPLE / max(total_rows, 1)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        parser = Parser()
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for begin, end in chunks(texts):
                _, _, _, trigger, phrase = parser.parse(texts[begin:end])
                pairs = np.unique(np.stack([trigger, phrase], 1), axis=0) if len(trigger) else np.empty((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].view(np.int64) if len(pairs) else [], pa.int64()) for i in (0, 1)], ["trigger", "phrase"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    found = sample.mapInArrow(run, "trigger long, phrase long").distinct().groupBy("trigger").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return [r["trigger"] for r in found.orderBy(F.desc("n"), "trigger").limit(MOST_COMMON).collect()]


def _unsigned(numbers: list[int]) -> list[int]:
    return [n % (1 << 64) for n in numbers]


def _phrases(rows: DataFrame, buckets: int, common: list[int]) -> DataFrame:
    """Packed records of each bucket: distinct phrases of a batch with their first document, and local verdicts.

    A phrase that an earlier document of the same batch holds is decided on the spot, so a phrase that very many
    documents share leaves a batch once.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        parser, names = Parser(common=_unsigned(common)), ["bucket", "local", "triggers", "phrases", "places", "docs"]
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), text_bytes(batch.column(1))
            parts = []
            for begin, end in chunks(texts):
                text, _, _, trigger, phrase = parser.parse(texts[begin:end])
                parts.append((trigger, phrase, ids[text + begin]))
            if not parts:
                continue
            trigger, phrase, doc = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((doc, phrase, trigger))
            trigger, phrase, doc = trigger[order], phrase[order], doc[order]
            if not len(doc):
                continue
            fresh = np.append(True, (phrase[1:] != phrase[:-1]) | (trigger[1:] != trigger[:-1]))
            first = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            later = (doc > first) & np.append(True, fresh[1:] | (doc[1:] != doc[:-1]))
            out: list[list] = [[], [], [], [], [], []]
            for local, chosen in ((False, fresh), (True, later)):
                t, p, d = trigger[chosen], phrase[chosen], doc[chosen]
                # verdicts need no meeting: they are dealt by document, evenly
                b = ((d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) if local else t >> np.uint64(8)) % np.uint64(buckets)
                by = np.argsort(b, kind="stable")
                t, p, d, b = t[by], p[by], d[by], b[by]
                edges = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)) if len(b) else []
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    # 14 bytes a record: 32 bits of the trigger (in its bucket), the phrase, a place in the row's own documents
                    own, place = np.unique(d[x:y], return_inverse=True)
                    low = b"" if local else (t[x:y] >> np.uint64(32)).astype(np.uint32).tobytes()
                    for column, value in zip(out, (int(b[x]), local, low, p[x:y].tobytes(), place.astype(np.uint16).tobytes(), own.tobytes()), strict=True):
                        column.append(value)
            kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return rows.mapInArrow(run, "bucket int, local boolean, triggers binary, phrases binary, places binary, docs binary")


def _grouped(doc, *values):
    """Arrow columns: the distinct documents and, for each, the lists of its values."""
    import numpy as np
    import pyarrow as pa

    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    edges = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)) if len(doc) else np.zeros(1, np.int64)
    lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(v[order].view(np.int64))) for v in values]
    return [pa.array(doc[edges[:-1]].astype(np.int64)), *lists]


def _decide(packed: DataFrame, parts: int) -> DataFrame:
    """Verdicts, packed for parts of the documents: phrases that an earlier document holds, and dictionary phrases that
    must be compared."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        done_phrase, done_doc, trigger, phrase, doc = ([np.empty(0, k)] for k in (np.uint64, np.int64, np.uint32, np.uint64, np.int64))
        for local, t, p, place, own in zip(*(table.column(c).to_pylist() for c in ("local", "triggers", "phrases", "places", "docs")), strict=True):
            d = np.frombuffer(own, np.int64)[np.frombuffer(place, np.uint16)]
            if local:
                done_phrase.append(np.frombuffer(p, np.uint64))
                done_doc.append(d)
            else:
                trigger.append(np.frombuffer(t, np.uint32))
                phrase.append(np.frombuffer(p, np.uint64))
                doc.append(d)
        done_phrase, done_doc, trigger, phrase, doc = map(np.concatenate, (done_phrase, done_doc, trigger, phrase, doc))
        found = []
        if len(doc):
            order = np.lexsort((doc, phrase, trigger))
            trigger, phrase, doc = trigger[order], phrase[order], doc[order]
            new_trigger = np.append(True, trigger[1:] != trigger[:-1])
            fresh = new_trigger | np.append(True, phrase[1:] != phrase[:-1])
            entry = np.flatnonzero(fresh)
            later = doc > doc[entry][np.cumsum(fresh) - 1]
            done_phrase, done_doc = np.append(done_phrase, phrase[later]), np.append(done_doc, doc[later])
            group = (np.cumsum(new_trigger) - 1)[entry]
            edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            least, most = np.minimum.reduceat(doc[entry], edges), np.maximum.reduceat(doc[entry], edges)
            contested = entry[(least < most)[group]]
            found.append((doc[contested], phrase[contested], True))
        found.append((done_doc, done_phrase, False))
        doc = np.concatenate([f[0] for f in found])
        phrase = np.concatenate([f[1] for f in found])
        compared = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
        part = (doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(parts)
        by = np.argsort(part, kind="stable")
        doc, phrase, compared, part = doc[by], phrase[by], compared[by], part[by]
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
        cut_up = lambda x: [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        columns = [pa.array(part[edges[:-1]].astype(np.int32)), *(pa.array(cut_up(x), pa.binary()) for x in (doc, phrase, compared))]
        return pa.table(columns, names=["part", "docs", "phrases", "compared"])

    return packed.groupBy("bucket").applyInArrow(run, "part int, docs binary, phrases binary, compared binary")


def _by_document(verdicts: DataFrame) -> DataFrame:
    """(id, repeats, compared): one row for each document that has verdicts."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        doc, phrase, compared = read("docs", np.int64), read("phrases", np.uint64), read("compared", np.bool_)
        order = np.lexsort((compared, doc))
        doc, phrase, compared = doc[order], phrase[order].view(np.int64), compared[order]
        edges = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        # the lists' offsets count the values of either kind before each document
        lists = []
        for wanted in (False, True):
            mine = compared == wanted
            lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(mine))[edges].astype(np.int32)), pa.array(phrase[mine])))
        return pa.table([pa.array(doc[edges[:-1]]), *lists], names=["id", "repeats", "compared"])

    return verdicts.groupBy("part").applyInArrow(run, "id long, repeats array<long>, compared array<long>")


def _pieces(joined: DataFrame, buckets: int, common: list[int]) -> DataFrame:
    """The dictionary phrases to compare, with their bytes: (bucket, doc_id, phrase, piece)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        parser = Parser(common=_unsigned(common))
        for batch in batches:
            ids, texts, wanted = batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()
            out: list[list] = [[], [], [], []]
            for begin, end in chunks(texts):
                text, start, count, trigger, phrase = parser.parse(texts[begin:end])
                edges = np.searchsorted(text, np.arange(end - begin + 1))
                for i in range(end - begin):
                    own = slice(edges[i], edges[i + 1])
                    hit = np.flatnonzero(np.isin(phrase[own].view(np.int64), wanted[begin + i])) + edges[i]
                    hit = hit[np.unique(phrase[hit], return_index=True)[1]]
                    for column, values in zip(out, ((trigger[hit] >> np.uint64(8)) % np.uint64(buckets), np.full(len(hit), ids[begin + i]), phrase[hit].view(np.int64), [texts[begin + i][s : s + c + MATCH - 1] for s, c in zip(start[hit], count[hit], strict=True)]), strict=True):
                        column.extend(values)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["bucket", "doc_id", "phrase", "piece"])

    return joined.mapInArrow(run, "bucket int, doc_id long, phrase long, piece binary")


def _suffix_array(pieces: DataFrame) -> DataFrame:
    """Orders the suffixes of a bucket's dictionary phrases by their bytes, then by document; (doc_id, phrases, masks): bit i
    marks a phrase's i-th suffix as one that an earlier document holds."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        doc, phrase = table.column("doc_id").to_numpy(), table.column("phrase").to_numpy()
        head, piece, offset = suffixes_of(table.column("piece").to_pylist())
        order = np.lexsort((doc[piece], *(head[:, i] for i in range(head.shape[1] - 1, -1, -1))))
        head, piece, offset = head[order], piece[order], offset[order]
        fresh = np.append(True, (head[1:] != head[:-1]).any(1)) if len(head) else np.empty(0, bool)
        repeated = doc[piece] > doc[piece][np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(head) else fresh
        masks = np.zeros(len(doc), np.int64)
        np.bitwise_or.at(masks, piece[repeated], np.left_shift(np.int64(1), offset[repeated]))
        hit = masks != 0
        return pa.table(_grouped(doc[hit], phrase[hit], masks[hit]), names=["doc_id", "phrases", "masks"])

    return pieces.groupBy("bucket").applyInArrow(run, "doc_id long, phrases array<long>, masks array<long>")


def _removed(joined: DataFrame, kind: str, common: list[int]) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        parser = Parser(common=_unsigned(common))
        for batch in batches:
            texts = text_bytes(batch.column(1))
            repeats, phrases, masks = (batch.column(i).to_pylist() for i in (2, 3, 4))
            n_removed, n_spans, digest = [], [], []
            for begin, end in chunks(texts):
                busy = [i for i in range(begin, end) if repeats[i] or phrases[i]]
                text, start, count, _, phrase = parser.parse([texts[i] for i in busy])  # one text, or few bytes
                edges = np.searchsorted(text, np.arange(len(busy) + 1))
                place = {i: k for k, i in enumerate(busy)}
                for i in range(begin, end):
                    data = texts[i]
                    if i not in place:
                        n_removed.append(0)
                        n_spans.append(0)
                        digest.append(hashlib.sha256(data).hexdigest())
                        continue
                    own = slice(edges[place[i]], edges[place[i] + 1])
                    s, c, p = start[own], count[own], phrase[own].view(np.int64)
                    change = np.zeros(len(data) + 1, np.int32)
                    whole = np.isin(p, repeats[i])
                    np.add.at(change, s[whole], 1)
                    np.add.at(change, s[whole] + c[whole] + MATCH - 1, -1)
                    if phrases[i]:
                        mask = dict(zip(phrases[i], masks[i], strict=True))
                        for k in np.flatnonzero(np.isin(p, phrases[i]) & ~whole):
                            bits = mask[int(p[k])]
                            w = s[k] + np.flatnonzero([bits >> j & 1 for j in range(c[k])])
                            np.add.at(change, w, 1)
                            np.add.at(change, w + MATCH, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0)
                    digest.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
            size = pa.array([len(t) for t in texts], pa.int64())
            arrays = [batch.column(0), size, pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each row of ``docs``.

    Every byte goes that a MATCH-byte string covers which also starts in a document with a smaller id.  Null text is
    empty.  A null id comes neither before nor after another: such rows lose nothing and cost others nothing.  Rows of
    one id are parts of one document: they don't count against each other.  Texts below MATCH bytes stay whole.
    An empty table gives no rows.  Other columns are not read.
    """
    spark = session_of(docs)
    small_batches(spark)
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(1, -(-total // BUCKET_BYTES))
    numbered = rows.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))

    common = common_triggers(numbered, count)
    replies = _by_document(cut(_decide(_phrases(numbered, buckets, common), buckets)))

    # Both joins below shuffle the same texts the same way, so Spark shuffles them once.
    joined = numbered.join(replies, F.col("doc_id") == F.col("id"), "left")
    dictionary = _pieces(joined.where(F.size("compared") > 0).select("id", "text", "compared"), buckets, common)
    windows = _suffix_array(dictionary).groupBy(F.col("doc_id").alias("id2")).agg(*[F.flatten(F.collect_list(n)).alias(n) for n in ("phrases", "masks")])
    final = joined.join(windows, F.col("id") == F.col("id2"), "left").select("doc_id", "text", "repeats", "phrases", "masks")
    nameless = rows.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), "text", *[F.lit(None).cast("array<long>").alias(c) for c in ("repeats", "phrases", "masks")])
    out = _removed(final, "long", common).unionByName(_removed(nameless, "long", common))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
