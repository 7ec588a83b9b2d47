"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read here (no protobuf library): pieces with scores and kinds, trainer and normaliser settings.
From them a tokenizer of the tokenizers library is rebuilt: normaliser, metaspace marker, merges or unigram scores, and
byte fallback.  Parity with the sentencepiece library is verified on probes whenever a model is loaded, and by tests.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters encoded at a time; distinct words whose ids a worker remembers (it starts anew then) and the longest of them
#: (longer ones hardly come again); threads of the library in a worker.
CALL, REMEMBERED, LONGEST, THREADS = 1 << 19, 200_000, 64, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of the fields of a protobuf message: integers, bytes and 32-bit floats."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError(f"protobuf wire type {kind}")
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    """What a SentencePiece model file says."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool


def read_model(data: bytes) -> Model:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            p = dict(fields(value))
            pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normaliser = dict(fields(value))
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return Model(tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), unknown, normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))


def merges_of(model: Model) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, best score first; the order of pieces decides between equal scores."""
    known = {p: (-score, i) for i, (p, score, kind) in enumerate(model.pieces) if kind == NORMAL}
    found = []
    for piece, rank in known.items():
        found += [(rank, cut, piece[:cut], piece[cut:]) for cut in range(1, len(piece)) if piece[:cut] in known and piece[cut:] in known]
    return [(a, b) for _, _, a, b in sorted(found)]


def rebuild(model: Model):
    """The model as a tokenizer of the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if any(kind == USER for _, _, kind in model.pieces):
        raise ValueError("models with user-defined pieces are not supported")
    vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = model.pieces[model.unknown][0]
    if model.kind == BPE:
        core = models.BPE(vocab=vocabulary, merges=merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"SentencePiece model type {model.kind}")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind == NORMAL):
        # no piece reaches over the start of a word: words can be encoded (and remembered by the library) one by one
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


PROBES = ("", " ", "a", "Hello  world", "  two   spaces ", "tab\tand\nline\r\n", "naïve café – “quotes”", "日本語 текст עברית 😀", "x" * 300, "0123456789 3.14 1e-9", "<s> </s> <unk> <0x41>", "#include <a.h> // ▁ mark", "\x00\x01\x7f")


def verify_parity(tokenizer, data: bytes, probes: tuple[str, ...] = PROBES) -> None:
    """Raises ValueError unless the sentencepiece library gives the same ids and texts for the probes."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    for probe in probes:
        ids = tokenizer.encode(probe, add_special_tokens=False).ids
        if ids != library.encode(probe) or tokenizer.decode(ids, skip_special_tokens=False) != library.decode(ids):
            raise ValueError(f"the rebuilt tokenizer differs from sentencepiece on {probe!r}")


def _load(model_path: str):
    with open(model_path, "rb") as f:
        data = f.read()
    model = read_model(data)
    tokenizer = rebuild(model)
    verify_parity(tokenizer, data)
    return model, tokenizer


def _calls(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CALL characters."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > CALL:
            yield begin, i
            begin, size = i, 0
        size += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)


def _at_words(text: str) -> Iterator[str]:
    """A normalised text in parts of about CALL characters that begin at the start of a word."""
    begin = 0
    while len(text) - begin > CALL:
        end = text.find(MARK, begin + CALL)
        while end > 0 and text[end - 1] == MARK:  # a run of marks belongs to the word after it
            end -= 1
        if end <= begin:
            break
        yield text[begin:end]
        begin = end
    yield text[begin:]


class Encoder:
    """Encodes and decodes batches on a worker, with the library's ids.

    Where no piece reaches over the start of a word, a batch is that of the words which are new to the worker; other
    models get batches of whole texts.  Either way the library spreads a batch over its threads.
    """

    def __init__(self, tokenizer_json: str):
        import os
        import re

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.by_word = self.tokenizer.pre_tokenizer is not None
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.core = Tokenizer(self.tokenizer.model)  # words are normalised and cut already
        self.known: dict[str, bytes] = {}
        self.strips = '"Strip"' in tokenizer_json
        vocabulary = {i: p for p, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        byte = re.compile(r"<0x([0-9A-F]{2})>").fullmatch
        self.table = [bytes([int(m[1], 16)]) if (m := byte(vocabulary[i])) else vocabulary[i].replace(MARK, " ").encode() for i in range(len(vocabulary))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as 32-bit integers."""
        import numpy as np

        pack = lambda ids: np.array(ids, np.int32).tobytes()
        if not self.by_word:
            return [pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        normal = self.tokenizer.normalizer.normalize_str
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in _at_words(normal(text)) if text else ():
                waiting.append((i, self.words(part)))
                size += len(part)
                if size >= CALL:
                    self._encode_words(waiting, out)
                    waiting, size = [], 0
        self._encode_words(waiting, out)
        return [b"".join(x) for x in out]

    def _encode_words(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        import numpy as np

        new = list({w for _, words in waiting for w in words}.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list({w for _, words in waiting for w in words})
        for w, e in zip(new, self.core.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, np.int32).tobytes()
        for i, words in waiting:
            out[i].append(b"".join(map(self.known.__getitem__, words)))
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; same as the library's decoder."""
        data = b"".join(map(self.table.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:  # the library says how broken byte pieces read
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.strips and text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", round_trip: str = "") -> DataFrame:
    """``docs`` with a column of piece ids (array<int>) of each whole text; all columns stay.

    Null text gives null ids, an empty one an empty list.  No begin, end or special tokens.  A column already named
    ``ids`` is replaced.  With ``round_trip`` there is a column of that name: whether decoding the ids gives the text back
    (true for null); the same worker decodes, so no second one holds the model.  The model file is read on the driver and
    travels with the tasks.
    """
    from pyspark.sql import types as T

    spark = session_of(docs)
    small_batches(spark)
    _, tokenizer = _load(model_path)
    shared = spark.sparkContext.broadcast(tokenizer.to_str())
    kept = [c for c in docs.columns if c not in (ids, round_trip)]
    added = [ids, round_trip] if round_trip else [ids]
    at = kept.index(text)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(shared.value)
        for batch in batches:
            texts, out, same = batch.column(at).to_pylist(), [], []
            for begin, end in _calls(texts):
                out += encoder.encode([t or "" for t in texts[begin:end]])
                if round_trip:
                    same += [encoder.decode(np.frombuffer(x, np.int32).tolist()) == (t or "") for x, t in zip(out[begin:], texts[begin:end], strict=True)]
            sizes = np.fromiter((len(x) // 4 for x in out), np.int64, len(out))
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(out), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([t is None for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *([pa.array(same, pa.bool_())] if round_trip else [])], [*kept, *added])

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(round_trip, T.BooleanType())]
    schema = T.StructType([*docs.select(*kept).schema.fields, *fields[: len(added)]])
    return docs.select(*kept).mapInArrow(run, schema)


def decode(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of its piece ids; all columns stay (one named ``text`` is replaced).  Null stays null."""
    from pyspark.sql import types as T

    spark = session_of(docs)
    small_batches(spark)
    _, tokenizer = _load(model_path)
    shared = spark.sparkContext.broadcast(tokenizer.to_str())
    kept = [c for c in docs.columns if c != text]
    at = kept.index(ids)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder(shared.value)
        for batch in batches:
            out = [None if x is None else encoder.decode(x) for i in range(0, batch.num_rows, 64) for x in batch.column(at).slice(i, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*kept, text])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(text, T.StringType())])
    return docs.select(*kept).mapInArrow(run, schema)


def piece_report(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, n_byte_tokens, ids_sha256, round_trip): encodes every text and decodes it again.

    n_byte_tokens counts pieces of the byte fallback.  ids_sha256 is the hash of the ids as little-endian 32-bit
    integers.  round_trip tells whether decoding gives the text back (it can't where the text holds the marker itself).
    Null text counts as empty.  One row for each row of ``docs``, repeated ones too; an empty table gives none.
    """
    spark = session_of(docs)
    small_batches(spark)
    model, tokenizer = _load(model_path)
    low = [i for i, (_, _, kind) in enumerate(model.pieces) if kind == BYTE]
    first, last = (min(low), max(low)) if low else (-1, -2)
    shared = spark.sparkContext.broadcast(tokenizer.to_str())

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        encoder = Encoder(shared.value)
        names = ["doc_id", "n_bytes", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            texts, out = [t or "" for t in batch.column(1).to_pylist()], []
            for begin, end in _calls(texts):
                part = texts[begin:end]
                for t, packed in zip(part, encoder.encode(part), strict=True):
                    ids = np.frombuffer(packed, np.int32)
                    fallback = int(((ids >= first) & (ids <= last)).sum())
                    out.append((len(t.encode()), len(ids), fallback, hashlib.sha256(packed).hexdigest(), encoder.decode(ids.tolist()) == t))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)[doc_id]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")
