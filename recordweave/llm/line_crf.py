"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad.  Its features are counts of character classes and words of the line itself and of
the lines before and after it.  The field is trained on a bounded sample of labelled documents.  Only documents have
labels, so those of lines are bootstrapped: at first a line has its document's, then rounds of fitting lines by their own
features turn those that speak clearly against it (a good passage in a bad document, junk in a good one), up to a share of
the document's length.  The field is then trained on chains that change their state.  A document's score is the mean of
its lines' forward-backward marginals, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, session_of, small_batches, text_bytes

#: Labelled documents per class that the field is trained on at most, and their greatest length in characters.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 2000, 20_000
FOLDS, THRESHOLD = 5, 0.3
#: Rounds of labelling lines anew, the log-odds against its document's label that turn a line, and the share of a
#: document's length that may turn (its label holds for the rest).
ROUNDS, AGAINST, TURNED = 3, 1.5, 0.2
#: Text bytes whose lines are scored together, and bytes that are looked at at a time (cut between words).
CHUNK, PIECE = 1 << 19, 1 << 20
OWN = 13
STEPS, RATE, PENALTY = 150, 0.1, 1e-3

_LOWER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _CRY, _POINT, _WIDE = range(8)


def _classes():
    import numpy as np

    table = np.full(256, _POINT, np.int64)
    table[ord("a") : ord("z") + 1] = _LOWER
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[[32, *range(9, 14)]] = _SPACE
    table[[ord(c) for c in "#*$%&|<>=^~@\\/{}[]_"]] = _SYMBOL
    table[ord("!")] = _CRY
    table[128:] = _WIDE
    return table


class Lines:
    """Features of the lines of many texts, computed over the joined bytes at once."""

    def __init__(self):
        import numpy as np

        self.table = _classes()
        self.codes = np.random.default_rng(11).integers(1, 1 << 62, 256, np.uint64)

    def pieces(self, data) -> Iterator[tuple[int, int]]:
        """Ranges of about PIECE bytes that end after white space, so no word lies in two (unless it is longer)."""
        import numpy as np

        begin = 0
        while begin < len(data):
            end = min(begin + PIECE, len(data))
            while end < len(data):
                spaces = np.flatnonzero(self.table[data[begin:end]] == _SPACE)
                if len(spaces):
                    end = begin + int(spaces[-1]) + 1
                    break
                end = min(end + PIECE, len(data))
            yield begin, end
            begin = end

    def own(self, texts: list[bytes]):
        """(document, line, length, features) of every line that has a word; a text without such lines counts as one line.

        Memory follows the lines that have words and the size of a piece, not the text.
        """
        import numpy as np

        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        parts, number, before, line_at = [], 0, (None, -1), 0
        for begin, stop in self.pieces(data):
            d = data[begin:stop]
            kind = self.table[d]
            line_end = d == 10
            ends = np.flatnonzero(line_end)
            line = (np.cumsum(line_end) - line_end).astype(np.int32)
            lines = len(ends) + 1
            counts = np.bincount(line * 8 + kind, minlength=8 * lines).reshape(lines, 8)
            counts[: len(ends), _SPACE] -= 1  # the line's end
            space = kind == _SPACE
            from_ = np.flatnonzero(~space & np.append(True, space[:-1]))
            to = np.flatnonzero(space & np.append(False, ~space[:-1]))
            to = np.append(to, len(d)) if len(to) < len(from_) else to
            word_line = line[from_]
            sums = np.append(np.uint64(0), np.cumsum(self.codes[d]))
            word = (sums[to] - sums[from_]) ^ (to - from_).astype(np.uint64)
            again = np.append(len(word) > 0 and before == (int(word[0]), number), (word[1:] == word[:-1]) & (word_line[1:] == word_line[:-1]))[: len(word)].astype(bool)
            tail = kind[to - 1] if len(to) else np.empty(0, np.int64)
            odd = (tail == _SYMBOL) | (tail == _CRY)
            edges = np.concatenate([[0], ends + 1, [len(d)]])
            stops = np.append(ends, len(d))
            many = lambda at: np.bincount(at, minlength=lines)
            code = sums[stops] - sums[edges[:-1]]
            size = stops - edges[:-1]
            last = np.where(size > 0, d[np.maximum(stops - 1, 0)], 0)
            starts = np.append(line_at, begin + ends + 1)
            words = many(word_line)
            keep = words > 0
            keep[[0, -1]] = True  # may go on in another piece
            table = np.column_stack([counts, words, many(word_line[again]), many(word_line[odd]), many(line[d == ord("|")]), size])
            parts.append((number + np.flatnonzero(keep), table[keep], code[keep], last[keep], starts[keep]))
            if len(word):
                before = (int(word[-1]), number + int(word_line[-1]))
            number += len(ends)
            line_at = int(starts[-1])
        line, table, code, last, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        edges = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        table, code = np.add.reduceat(table, edges).astype(float), np.add.reduceat(code, edges)
        final = np.maximum.reduceat(np.where(last > 0, np.arange(len(last)), -1), edges)
        last = np.where(final >= 0, last[final], 0)
        line, start = line[edges], start[edges]
        has = table[:, 8] > 0
        line, table, code, last, start = line[has], table[has], code[has], last[has], start[has]
        doc = np.searchsorted(first, start, "right") - 1
        counts, (words, again, odd_tail, bars, size) = table[:, :8], table[:, 8:].T

        key = code ^ size.astype(np.uint64)
        order = np.lexsort((np.arange(len(doc)), key, doc))
        twin = np.append(False, (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1]))[: len(doc)]
        copied = np.zeros(len(doc))
        copied[order[twin]] = 1
        stop = np.isin(last, [ord(c) for c in ".!?"])

        letters, per_word = counts[:, _LOWER] + counts[:, _UPPER] + 1, words + 1
        features = np.stack(
            [
                np.log1p(size), np.log1p(words), counts[:, _UPPER] / letters, counts[:, _DIGIT] / (size + 1), counts[:, _SYMBOL] / per_word,
                counts[:, _CRY] / per_word, bars / per_word, odd_tail / per_word, again / per_word, size / per_word, counts[:, _WIDE] / (size + 1), stop, copied,
            ],
            1,
        )
        empty = np.ones(len(texts), bool)
        empty[doc] = False
        lone = np.flatnonzero(empty)
        own_line = line - np.searchsorted(_line_starts(data), first, "left")[doc] if len(doc) else line
        doc, own_line, size, features = np.append(doc, lone), np.append(own_line, np.zeros(len(lone), np.int64)), np.append(size, np.ones(len(lone))), np.concatenate([features, np.zeros((len(lone), OWN))])
        order = np.argsort(doc, kind="stable")
        return doc[order], own_line[order], size[order], features[order]


def _line_starts(data):
    import numpy as np

    return np.append(0, np.flatnonzero(data == 10) + 1)


def neighbours(doc):
    """Flags of lines with a line before and after them in the document."""
    import numpy as np

    same = doc[1:] == doc[:-1]
    return np.append(False, same)[: len(doc)], np.append(same, False)[: len(doc)]


def with_neighbours(doc, own):
    """A line's features, those of its neighbours in the document, flags of missing neighbours, and a constant."""
    import numpy as np

    has_before, has_after = neighbours(doc)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[has_before] = own[np.flatnonzero(has_before) - 1]
    after[has_after] = own[np.flatnonzero(has_after) + 1]
    return np.concatenate([own, before, after, (~has_before)[:, None], (~has_after)[:, None], np.ones((len(doc), 1))], 1)


def emissions(doc, own, weights):
    """``with_neighbours(doc, own) @ weights``, without making that matrix."""
    import numpy as np

    has_before, has_after = neighbours(doc)
    out = own @ weights[:OWN] + weights[-1]
    before, after = own @ weights[OWN : 2 * OWN], own @ weights[2 * OWN : 3 * OWN]
    return out + np.where(has_before, np.roll(before, 1), weights[-3]) + np.where(has_after, np.roll(after, -1), weights[-2])


class Chains:
    """Runs of lines by document, dealt so that step t handles every document that still has a line."""

    def __init__(self, doc):
        import numpy as np

        edges = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)) if len(doc) else np.zeros(1, np.int64)
        start, count = edges[:-1], np.diff(edges)
        order = np.argsort(-count, kind="stable")
        self.start, self.count = start[order], count[order]
        self.longest = int(count.max()) if len(count) else 0
        self.alive = [int(np.searchsorted(-self.count, -t, "left")) for t in range(self.longest)]  # documents with more than t lines

    def messages(self, emit, t):
        """Forward and backward log-odds of every line; t = (t00, t01, t10, t11)."""
        import numpy as np

        forward, backward = emit.copy(), np.zeros_like(emit)
        for i in range(1, self.longest):
            at = self.start[: self.alive[i]] + i
            a = forward[at - 1]
            forward[at] += np.logaddexp(t[1], t[3] + a) - np.logaddexp(t[0], t[2] + a)
        for i in range(self.longest - 1, 0, -1):
            at = self.start[: self.alive[i]] + i
            x = emit[at] + backward[at]
            backward[at - 1] = np.logaddexp(t[2], t[3] + x) - np.logaddexp(t[0], t[1] + x)
        return forward, backward


def sigmoid(x):
    import numpy as np

    return 0.5 * (1 + np.tanh(0.5 * x))


def line_marginals(model, texts: list[bytes]):
    """(document, line, length, chance that it is good) of the lines; the model is (mean, scale, weights, transitions)."""
    mean, scale, weights, transitions = model
    doc, line, size, own = LINES().own(texts)
    forward, backward = Chains(doc).messages(emissions(doc, (own - mean) / scale, weights), transitions)
    return doc, line, size, sigmoid(forward + backward)


def document_scores(model, texts: list[bytes]):
    import numpy as np

    doc, _, size, good = line_marginals(model, texts)
    return np.bincount(doc, good * size, len(texts)) / np.bincount(doc, size, len(texts))


_lines: list = []


def LINES() -> Lines:  # noqa: N802  one table per worker
    if not _lines:
        _lines.append(Lines())
    return _lines[0]


def slope(p, x, y, weight, chains, later):
    """Gradient of the weighted negative log-likelihood of the lines' labels, and the marginals' log-odds."""
    import numpy as np

    w, t = p[:-4], p[-4:]
    emit = x @ w
    forward, backward = chains.messages(emit, t)
    odds = forward + backward
    out = np.empty_like(p)
    out[:-4] = x.T @ (weight * (sigmoid(odds) - y))
    a, b = forward[later - 1], emit[later] + backward[later]
    pair = np.stack([np.full(len(later), t[0]), t[1] + b, t[2] + a, t[3] + a + b], 1)
    pair = np.exp(pair - pair.max(1, keepdims=True)) if len(later) else pair
    pair /= pair.sum(1, keepdims=True)
    real = np.zeros_like(pair)
    real[np.arange(len(later)), (2 * y[later - 1] + y[later]).astype(int)] = 1
    out[-4:] = (weight[later, None] * (pair - real)).sum(0)
    return out, odds


def fit(x, y, weight, chains, later, steps: int = STEPS):
    """Parameters after Adam steps over all documents, and the marginals' log-odds."""
    import numpy as np

    p = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        g = slope(p, x, y, weight, chains, later)[0] + PENALTY * p
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g**2
        p -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return p, slope(p, x, y, weight, chains, later)[1]


def line_labels(doc, size, label, odds):
    """Labels of lines: the document's, but for lines whose odds speak clearly against it, the clearest first, up to the
    share TURNED of the document's length."""
    import numpy as np

    against = np.where(label == 1, -odds, odds)
    order = np.lexsort((-against, doc))
    d, s = doc[order], size[order]
    total = np.bincount(doc, size)
    upto = np.cumsum(s)
    before = np.append(0, upto)[np.searchsorted(d, np.arange(len(total)))]
    turned = np.zeros(len(doc), bool)
    turned[order] = (against[order] > AGAINST) & (upto - before[d] <= TURNED * total[d])
    return np.where(turned, 1 - label, label)


def train(texts: list[bytes], labels: list[int]):
    """The model (mean, scale, weights, transitions) of labelled documents."""
    import numpy as np

    doc, _, size, own = LINES().own(texts)
    mean, scale = own.mean(0), own.std(0) + 1e-6
    x = with_neighbours(doc, (own - mean) / scale)
    label = np.asarray(labels, float)[doc]
    share = label.mean()
    weight = np.where(label == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(label)  # both classes weigh the same
    alone, own_only, none, y = Chains(np.arange(len(doc))), np.column_stack([(own - mean) / scale, np.ones(len(doc))]), np.empty(0, np.int64), label
    for _ in range(ROUNDS):
        turned = line_labels(doc, size, label, fit(own_only, y, weight, alone, none)[1])
        if (turned == y).all():
            break
        y = turned
    p, _ = fit(x, y, weight, Chains(doc), np.flatnonzero(neighbours(doc)[0]))
    return mean, scale, p[:-4].copy(), p[-4:].copy()


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo the folds, is 0 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most ``per_class`` documents of each class, outside the held-out fold, in hash order."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one = lambda q: ids.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = cut(one(0).unionByName(one(1)))
    rows = docs.join(F.broadcast(chosen), "doc_id").where(F.length("text") <= chars).dropDuplicates(["doc_id"])
    found = sorted(rows.select("doc_id", "text", "quality").toPandas().itertuples(index=False))
    return [r.text.encode() for r in found], [int(r.quality) for r in found]


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``.

    Null or empty text is scored as one empty line.  Repeated rows and null ids get a row each (a null id is not held
    out).  Without labelled documents of both classes every score is the share of label 1 (0.5 without labels).
    An empty table gives no rows.  Only id and text are read.
    """
    spark = session_of(docs)
    small_batches(spark)
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts, marks = labelled_sample(rows, labels)
    known = len(set(marks)) == 2
    field = spark.sparkContext.broadcast(train(texts, marks) if known else (sum(marks) / len(marks) if marks else 0.5))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = field.value  # plain arrays: an object would need this library on executors
        for batch in batches:
            texts = text_bytes(batch.column(1))
            scores, begin, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= CHUNK or i == len(texts) - 1:
                    part = texts[begin : i + 1]
                    scores.append(document_scores(model, part) if known else np.full(len(part), float(model)))
                    begin, size = i + 1, 0
            score = np.clip(np.concatenate(scores), 0, 1) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def line_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, line, n_bytes, good): for every line with a word of every row its number in the text (from 0), its
    length and the chance that it is good.  Texts without such lines have none.  Needs labelled documents of both classes."""
    spark = session_of(docs)
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts, marks = labelled_sample(rows, labels)
    if len(set(marks)) != 2:
        raise ValueError("labelled documents of both classes are needed")
    field = spark.sparkContext.broadcast(train(texts, marks))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, data in enumerate(text_bytes(batch.column(1))):
                if data.split(None, 1):
                    _, line, size, good = line_marginals(field.value, [data])
                    same = batch.column(0).take(pa.array(np.full(len(line), i)))
                    yield pa.RecordBatch.from_arrays([same, pa.array(line.astype(np.int64)), pa.array(size.astype(np.int64)), pa.array(good)], ["doc_id", "line", "n_bytes", "good"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, line long, n_bytes long, good double")
