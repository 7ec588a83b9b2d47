"""Personal data by fixed patterns and by bootstrapped contextual extraction.

Seed entities (the spans that the fixed patterns find, spaces and checks included, and keys of published formats) are
instances; the one or two words before an instance are lexical patterns.  Patterns and instances form a bipartite graph.  Rounds of scoring pass confidence
over it: a pattern is as good as the share of known instances among all that it precedes, an instance is as good as
the patterns that precede it.  Patterns of high confidence then mark identifiers that no fixed pattern knows.

All of it is DataFrame expressions: the text is scanned once, and only identifier-like strings and the words before
them leave that scan.  Positions come from the lengths between matches: a running sum per document, linear in matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

KINDS = ("email", "ip", "card", "phone", "key")
_CANDIDATE = 9

# The contract's patterns, written so that Java neither recurses nor rescans: possessive repeats where nothing can be
# given back, and starts only at the end of the last match or where no character of the same run stands before.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

#: Seeds beyond the base kinds: published key formats (prefix and capital letters, or 32 to 64 hex digits).
_KEY_SEED = r"\A(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,64}|gh[pousr]_[0-9A-Za-z]{36})\z"
#: Least length of an identifier; shorter strings are counts, versions and years.
SHORTEST = 6
#: Longer tokens, and those that hold a fixed pattern's span, fall apart at quotes, commas, braces, = and :.
SPLIT_FROM = 200
_PIECE = r"[^\"',{}=:]++"
#: Longer values are hashed where they are the graph's keys.
_KEY_CHARS = 64
_OPENING, _CLOSING = r"[\"'(\[{<]*", r"[\"')\]}>.,;:!?]+\z"
#: Least confidence of a pattern and of an instance, least known instances behind a pattern, rounds of scoring.
CONFIDENT, SUPPORT, ROUNDS = 0.7, 5, 3
_LEFT = 80
#: Code points in a block of a text that is cut at spans.
_BLOCK = 512


def _stream(kind: int, text: Column, pattern: str, needed: Column) -> Column:
    """Matches of a kind and what lies between them (its length and its end)."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.substring(g, -_LEFT, _LEFT).alias("left")))
    found = F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(needed, found)


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One pass over the texts: (row, doc_id, streams) with every identifier-like string and its surroundings."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    digit, at = t.rlike("[0-9]"), t.contains("@")
    streams = F.array(
        _stream(0, t, _EMAIL, at),
        _stream(1, t, _IP, t.rlike(r"[0-9]\.[0-9]")),
        _stream(2, t, _CARD, digit),
        _stream(3, t, _PHONE, t.contains("+")),
        _stream(_CANDIDATE, t, _TOKEN, digit | at),
    )
    kept = F.filter(streams, lambda s: s.isNotNull() & (F.size(s["hits"]) > 0))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", kept.alias("streams")))


def _occurrences(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end, hit, left) of every match, in code points."""
    flat = scanned.select("row", F.explode("streams").alias("s")).select("row", "s.kind", F.posexplode(F.arrays_zip("s.gaps", "s.hits")).alias("pos", "m"))
    flat = flat.select("row", "kind", "pos", F.col("m.gaps.n").alias("gap"), F.col("m.gaps.left").alias("left"), F.col("m.hits").alias("hit")).where(F.col("hit").isNotNull())
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(upto).cast("long"))
    return flat.select("row", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", "left")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, n - i, F.lit(1)).cast("int")
        v = F.when(i % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)
        return total + v

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_spans(occurrences: DataFrame) -> DataFrame:
    """The matches of the fixed patterns that pass their kind's test."""
    digits = F.regexp_replace("hit", "[^0-9]", "")
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    passes = (
        F.when(F.col("kind") == 0, F.lit(True))
        .when(F.col("kind") == 1, F.col("hit").rlike(rf"\A{part}(?:\.{part}){{3}}\z"))
        .when(F.col("kind") == 2, F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
        .when(F.col("kind") == 3, F.length(digits).between(8, 15))
    )
    return occurrences.where((F.col("kind") != _CANDIDATE) & passes).select("row", "kind", "start", "end", "hit", "left")


def _patterns(left: Column, name: Column) -> Column:
    """One word and two words before a string: ``left`` stands before it, ``name`` (name= or name:) is its own head.

    A name that ends ``left`` without a blank is treated alike, as are opening quotes and brackets.
    """
    near = F.regexp_replace(left, rf"{_OPENING}\z", "")
    glued = F.regexp_extract(near, r"([^\x20\x09-\x0D0-9@,{}]*[=:])\z", 1)
    near = F.regexp_replace(near, r"[^\x20\x09-\x0D0-9@,{}]*[=:]\z", "")
    context = F.concat_ws(" ", F.regexp_replace(near, "[0-9]", "0"), F.regexp_replace(F.concat(glued, name), "([=:])", " $1"))
    before = F.filter(F.split(F.lower(context), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    last, second = (lambda w: F.get(w, F.size(w) - 1)), (lambda w: F.get(w, F.size(w) - 2))
    return F.array_distinct(F.array_compact(F.transform(F.array(before), lambda w: F.array(last(w), F.concat_ws(" ", second(w), last(w))))[0]))


def _values(tokens: DataFrame) -> DataFrame:
    """(row, start, end, value, patterns) of tokens (row, start, hit, left) without what encloses them."""
    # name=value and name:value: the name is context
    c = tokens.withColumn("head", F.regexp_extract("hit", rf"\A([^0-9@]*[=:])?{_OPENING}", 0)).withColumn("name", F.regexp_extract("hit", r"\A([^0-9@]*[=:])", 1))
    c = c.withColumn("value", F.regexp_replace(F.expr("substring(hit, length(head) + 1)"), _CLOSING, "")).where(F.length("value") >= SHORTEST)
    c = c.withColumn("start", F.col("start") + F.length("head")).withColumn("end", F.col("start") + F.length("value"))
    return c.where(F.col("value").rlike("[0-9@]"))


def _marked(spans: DataFrame, base: DataFrame) -> DataFrame:
    """``spans`` with ``clear``: whether they overlap no base span, by one ordered pass over a document's spans."""
    fixed = base.select("row", "start", "end", F.lit(0).alias("added"))
    both = spans.withColumn("added", F.lit(1)).unionByName(fixed, allowMissingColumns=True)
    back = Window.partitionBy("row").orderBy("start", "added").rowsBetween(Window.unboundedPreceding, -1)
    # What follows is what precedes in the opposite order: a frame that ends at the last row would be gone through for each row.
    ahead = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("added")).rowsBetween(Window.unboundedPreceding, -1)
    fixed_end, fixed_start = F.when(F.col("added") == 0, F.col("end")), F.when(F.col("added") == 0, F.col("start"))
    both = both.withColumn("end_before", F.max(fixed_end).over(back)).withColumn("start_after", F.min(fixed_start).over(ahead))
    clear = (F.coalesce("end_before", F.lit(0)) <= F.col("start")) & (F.coalesce("start_after", F.col("end")) >= F.col("end"))
    return both.withColumn("clear", clear).where("added = 1").drop("added", "end_before", "start_after")


def _pieces(tokens: DataFrame) -> DataFrame:
    """Parts (row, start, hit, left) of tokens (row, start, hit, left) between quotes, commas, braces, = and :."""
    parts = F.arrays_zip(F.split("hit", _PIECE, -1).alias("gap"), F.regexp_extract_all("hit", F.lit(_PIECE), F.lit(0)).alias("hit"))
    p = tokens.select("row", F.col("start").alias("token"), F.col("left").alias("outer"), F.posexplode(parts).alias("pos", "m"))
    p = p.select("row", "token", "outer", "pos", "m.gap", "m.hit").where("hit is not null")
    order = Window.partitionBy("row", "token").orderBy("pos")
    ended = F.sum(F.length("gap") + F.length("hit")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    tail = lambda x: F.substring(x, -_LEFT, _LEFT)
    earlier = F.when(F.col("pos") > 1, F.lag(tail(F.col("gap"))).over(order)).otherwise(F.concat("outer", F.coalesce(F.lag(tail(F.col("gap"))).over(order), F.lit(""))))
    left = tail(F.concat(earlier, F.coalesce(F.lag(tail(F.col("hit"))).over(order), F.lit("")), tail(F.col("gap"))))
    return p.select("row", (F.col("token") + ended - F.length("hit")).alias("start"), "hit", left.alias("left"))


def candidates(occurrences: DataFrame) -> DataFrame:
    """Instances with their patterns: the spans of the fixed patterns and published keys, which are seeds of their kind,
    and identifier-like strings that overlap no such span (row, start, end, value, patterns, seed, shape)."""
    base = base_spans(occurrences)
    tokens = occurrences.where(F.col("kind") == _CANDIDATE).select("row", "start", "hit", "left")
    kept = ["row", "start", "end", "hit", "left", "name", "value"]
    whole = cut(_marked(_values(tokens).withColumn("from", F.col("start") - F.length("head")).select(*kept, "from"), base))
    split = ~F.col("clear") | (F.length("hit") > SPLIT_FROM)
    pieces = _marked(_values(_pieces(whole.where(split).select("row", F.col("from").alias("start"), "hit", "left"))).select(*kept), base).where("clear")
    found = whole.where(~split).select(*kept).unionByName(pieces.select(*kept))
    found = found.withColumn("seed", F.when(F.col("value").rlike(_KEY_SEED), 4))
    # What is glued to the match before (its own token) is no word before this one.
    seeds = base.withColumn("left", F.regexp_replace("left", r"\A[^\x20\x09-\x0D]++(?=[\x20\x09-\x0D])", "")).select("row", "start", "end", "left", F.lit("").alias("name"), F.col("hit").alias("value"), F.col("kind").cast("int").alias("seed"))
    found = found.drop("hit").unionByName(seeds)
    v = F.col("value")
    shape = F.when(v.contains("@"), 0).when(v.rlike(r"\A[\x200-9.()+-]+\z"), 1).otherwise(2)
    key = F.when(F.length(v) > _KEY_CHARS, F.sha2(v, 256)).otherwise(v)
    return found.select("row", "start", "end", key.alias("value"), _patterns(F.col("left"), F.col("name")).alias("patterns"), "seed", shape.alias("shape"))


def confident_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, shape, confidence) after scoring the graph of patterns and instances for some rounds.

    Edges are distinct (pattern, instance) pairs with their shape.  Known instances start at 1 for their seed's kind.
    A pattern's confidence for a kind is the sum of its instances' scores over the number of its instances plus one;
    an instance gets 1 - product(1 - confidence) over its confident patterns.  Only confident patterns (few) are
    kept between rounds; as a written table, so that Spark deals both sides of its joins and splits the rows of a very
    common word, or broadcasts the patterns after measuring them.
    """
    edges = found.select(F.explode("patterns").alias("pattern"), "value", "shape", "seed").groupBy("pattern", "shape", "value").agg(F.max("seed").alias("seed"))
    edges = cut(edges)
    all_of = edges.groupBy("pattern", "shape").agg(F.count(F.lit(1)).alias("instances"))
    score = edges.where("seed is not null").select("pattern", "shape", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    known = score
    patterns = None
    for _ in range(rounds):
        kinds = score.groupBy("pattern", "shape", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= SUPPORT)
        scored = kinds.join(all_of, ["pattern", "shape"]).withColumn("confidence", F.col("mass") / (F.col("instances") + 1))
        patterns = cut(scored.where(F.col("confidence") >= CONFIDENT).select("pattern", "shape", "kind", "confidence"))
        reached = edges.where("seed is null").join(patterns, ["pattern", "shape"])
        values = reached.groupBy("value", "shape", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        values = values.where(F.col("score") >= CONFIDENT)
        score = known.unionByName(edges.where("seed is null").join(values, ["value", "shape"]).select("pattern", "shape", "kind", "score"))
    return patterns


def discovered_spans(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Key seeds, and instances that confident patterns precede."""
    rest = found.where("seed is null").select("row", "start", "end", "shape", F.explode("patterns").alias("pattern"))
    hits = rest.join(patterns, ["pattern", "shape"]).groupBy("row", "start", "end").agg(F.max(F.struct("confidence", F.col("kind"))).alias("best"))
    return hits.select("row", F.col("best.kind").alias("kind"), "start", "end").unionByName(found.where("seed = 4").select("row", F.lit(4).alias("kind"), "start", "end"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def private_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(scanned, spans): a row per document (row, doc_id), and the sorted spans of those that have any (row, base, spans)."""
    scanned = scan(docs, doc_id, text)
    seen = cut(_occurrences(scanned))
    base = base_spans(seen).select("row", "kind", "start", "end")
    found = cut(candidates(seen))
    added = discovered_spans(found, confident_patterns(found))
    spans = base.withColumn("fixed", F.lit(True)).unionByName(added.withColumn("fixed", F.lit(False)))
    one = F.struct("kind", "start", "end")
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("fixed"), one))).alias("base"), F.sort_array(F.collect_list(one)).alias("spans"))
    return scanned.select("row", "doc_id"), spans


def find_private_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each row of ``docs``.

    Counts and base_sha256 are of the fixed patterns; spans also holds what the method found (kinds as above and key).
    Null or empty text: no spans (the hash is that of the empty string).  Repeated rows and null ids get a row each,
    as if alone.  An empty table gives no rows.  Other columns are not read.
    """
    rows, spans = private_spans(docs, doc_id, text)
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    out = rows.join(spans, "row", "left").withColumn("base", F.coalesce("base", none)).withColumn("spans", F.coalesce("spans", none))
    counts = [_count("base", k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _united(spans: DataFrame) -> DataFrame:
    """(row, united): disjoint spans in order; overlapping ones are one, of the kind of the first (the longest of equal starts)."""
    s = spans.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    s = s.withColumn("upto", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("group", F.count_if(F.coalesce(F.col("start") >= F.col("upto"), F.lit(True))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct("start", (-F.col("end")).alias("longest"), "kind")
    s = s.groupBy("row", "group").agg(F.min(one).alias("first"), F.max("end").alias("end"))
    return s.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first.start", "end", "first.kind"))).alias("united"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; all columns stay, n_chars follows the text.

    The spans of all kinds are united first (overlapping ones become one, named by the first), so nothing of an
    identifier is left behind.  Ids may be null or repeated: a row's spans follow from its text, whose hash joins them.
    Null and empty texts stay as they are, as do extra columns, whatever their names; an empty table stays empty.
    """
    key_name, of_name, spans_name, blocks_name = unused(docs, "__key", "__of", "__spans", "__blocks")
    keyed = F.md5(F.col(text).cast("binary"))
    rows, spans = private_spans(docs.select(keyed.alias("key"), F.col(text).alias("text")), "key", "text")
    flat = _united(spans).join(rows, "row").groupBy("doc_id").agg(F.first("united").alias(spans_name))
    # As binary on both sides: the join deals both anew, so Spark can split the rows of a text that very many hold.
    found = flat.select(F.unhex("doc_id").alias(key_name), spans_name)
    joined = docs.withColumn(of_name, F.unhex(keyed)).join(found, F.col(of_name) == F.col(key_name), "left")
    # The text in blocks, so that a piece is found without walking all of it; a generator, so that they are made once a row.
    blocks = F.when(F.size(spans_name) > 0, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)))
    joined = joined.select("*", F.explode(F.array(blocks)).alias(blocks_name))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def between(a: Column, b: Column) -> Column:
        block = lambda k: F.substring(F.get(blocks_name, k), F.greatest(a - k * _BLOCK, F.lit(0)) + 1, F.least(b - k * _BLOCK, F.lit(_BLOCK)) - F.greatest(a - k * _BLOCK, F.lit(0)))
        of = lambda x: F.floor(x / _BLOCK).cast("int")
        return F.array_join(F.transform(F.sequence(of(a), of(F.greatest(a, b - 1))), block), "")

    ended = lambda i: F.coalesce(F.get(spans_name, i - 1)["end"], F.lit(0)).cast("int")
    pieces = F.transform(F.col(spans_name), lambda s, i: F.concat(between(ended(i), s["start"].cast("int")), F.get(names, s["kind"])))
    rest = between(ended(F.size(spans_name)), F.size(blocks_name) * _BLOCK)
    out = joined.withColumn(text, F.when(F.size(spans_name) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans_name) > 0, F.length(F.col(text)).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
