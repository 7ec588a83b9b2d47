"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are vocabulary entries.  Which of those entries really encode alone as one token is proved
once, offline, by encoding each of them with the tokenizers library (``prove_whole_tokens``).  Counting then needs no
merges for a pre-token that is in the proved set; the rest are merged by the library, once per distinct string.

A pre-token always encodes alone as it does inside a text: the pattern would cut it at the same place, because each of
its alternatives matches a run of one character class and only looks ahead for the end of white space.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, small_batches

#: Distinct merged strings that a worker remembers, and characters of them; it starts anew beyond either (bounded memory).
REMEMBERED, REMEMBERED_CHARS = 400_000, 16 << 20


def check_layout(tokenizer_json: str) -> None:
    """Raises ValueError for tokenizers whose counts don't follow from byte-level pre-tokens and plain merges alone."""
    spec = json.loads(tokenizer_json)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    faults = [
        (model.get("type") != "BPE" or any(model.get(x) for x in plain), "a model other than plain BPE"),
        (cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True), "a splitter other than the byte-level one"),
        (spec["normalizer"] is not None, "a normaliser"),
        (any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]), "added tokens that look at what is beside them"),
    ]
    if found := [name for fault, name in faults if fault]:
        raise ValueError("token_counts can't count with " + ", ".join(found))


def class_ranges(tokenizer) -> dict[str, str]:
    """Character classes of the library's splitting pattern over the basic plane, as ranges for ``re``.

    They are read off the library itself, so other Unicode versions in ``re`` don't matter.
    """
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    found: dict[str, list[list[int]]] = {"L": [], "N": [], "S": []}
    for n in range(0x10000):
        if 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        kind = "L" if len(cut("a" + c)) == 1 else "N" if len(cut("1" + c)) == 1 else "" if len(cut("!" + c)) == 1 else "S"
        if kind:
            runs = found[kind]
            if runs and runs[-1][1] == n - 1:
                runs[-1][1] = n
            else:
                runs.append([n, n])
    return {k: "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) for k, runs in found.items()}


def split_pattern(ranges: dict[str, str]) -> str:
    """The byte-level splitting pattern (contractions, letters, numbers, others, white space) with explicit classes."""
    letter, number, space = ranges["L"], ranges["N"], ranges["S"]
    return rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


def prove_whole_tokens(tokenizer, pattern: str) -> frozenset[str]:
    """Strings of the vocabulary that are one pre-token and that the library encodes alone as one token."""
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size(with_added_tokens=False))]
    one = re.compile(pattern).fullmatch
    strings = [s for s in dict.fromkeys(strings) if s and "�" not in s and one(s)]
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1)


def byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters stand for themselves, others follow U+0100."""
    visible = [n for n in range(256) if 0x21 <= n <= 0x7E or 0xA1 <= n <= 0xAC or 0xAE <= n]
    hidden = [n for n in range(256) if n not in visible]
    return {n: chr(n) for n in visible} | {n: chr(256 + i) for i, n in enumerate(hidden)}


class Counter:
    """Counts tokens of texts on a worker."""

    def __init__(self, tokenizer_json: str, pattern: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.cut, self.whole = re.compile(pattern).findall, whole
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.table = byte_characters()
        self.merged: dict[str, int] = {}
        self.chars = 0

    def pieces(self, text: str) -> list[str]:
        if not self.beyond(text):
            return self.cut(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, texts: list[str]) -> list[int]:
        whole, merged, out, rest = self.whole, self.merged, [], []
        for text in texts:
            total, parts = 0, (text,)
            if self.added is not None and (special := len(self.added.findall(text))):
                total, parts = special, self.added.split(text)
            left: list[str] = []
            for part in parts:
                pieces = self.pieces(part)
                total += len(pieces)
                left += [p for p in pieces if p not in whole]
            out.append(total - len(left))
            rest.append(left)
        new = list({p for left in rest for p in left if p not in merged})
        if len(merged) + len(new) > REMEMBERED or self.chars + sum(map(len, new)) > REMEMBERED_CHARS:
            merged.clear()
            self.chars = 0
            new = list({p for left in rest for p in left})
        self.chars += sum(map(len, new))
        merge, table = self.tokenizer.model.tokenize, self.table
        for p in new:  # the library's merges alone, without its normaliser, splitter and offsets
            merged[p] = len(merge(p.encode().decode("latin-1").translate(table)))
        return [n + sum(map(merged.__getitem__, left)) for n, left in zip(out, rest, strict=True)]


def token_counts(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of ``docs``; other columns are not read.

    Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows and null ids give a row each.  An empty table gives
    no rows.  Added tokens inside a text count as the library's default has it: one token each.  The tokenizer file is
    read on the driver and travels with the task (its size is that of a vocabulary).  Other than byte-level BPE
    tokenizers are refused (``check_layout``).
    """
    from tokenizers import Tokenizer

    spark = session_of(docs)
    small_batches(spark)
    tokenizer = Tokenizer.from_file(tokenizer_path)
    check_layout(tokenizer.to_str())
    pattern = split_pattern(class_ranges(tokenizer))
    shared = spark.sparkContext.broadcast((tokenizer.to_str(), pattern, prove_whole_tokens(tokenizer, pattern)))

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        counter = Counter(*shared.value)
        for batch in batches:
            texts, n = batch.column(1).to_pylist(), []
            for i in range(0, len(texts), 64):
                n += counter.count([t or "" for t in texts[i : i + 64]])
            size = pa.array([0 if t is None else len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    id_type = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
