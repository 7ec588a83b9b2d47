"""Mixing, token counts, quality rules, classifier, SentencePiece and chat on small tables."""

import json
import random
import zlib
from pathlib import Path

import public_tokenizers
import pytest

from recordweave.llm.chat import format_conversations
from recordweave.llm.line_crf import quality_scores
from recordweave.llm.line_quality import clean_documents, line_quality, repeat_words
from recordweave.llm.mixing import mix_sources, mixed_documents
from recordweave.llm.pieces import PROBES, decode, encode, piece_report, read_model, rebuild, verify_parity
from recordweave.llm.token_counts import Counter, check_layout, class_ranges, prove_whole_tokens, split_pattern, token_counts

ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (3, " \n\t ", None), (None, "x y", "b"), (4, "word " * 30_000, "b"), (5, "naïve <|endoftext|> 日本 😀\x1c\x85", "c")]
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling by repetition."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full, budget = set(names), {}, sum(sizes.values())
    while True:
        rest = budget - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > most * sizes[s]}
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}
        left -= over
        if not left:
            return full


def test_mix_targets_and_takes(spark, documents):
    draw = random.Random(4)
    rows = [(i, "w " * draw.randint(1, 40), draw.choice(["a", "b", "c", "d", None] + ["a"] * 6)) for i in range(1500)]
    found = mix_sources(documents(rows)).toPandas()
    again = mix_sources(documents(rows).repartition(3)).toPandas()
    assert found.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    source = {i: s for i, _, s in rows}
    sizes, takes = {}, {}
    for r in found.itertuples():
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
        takes[source[r.doc_id]] = takes.get(source[r.doc_id], 0) + r.taken
        assert r.taken <= 3 * r.size and r.taken % r.size == 0
    wanted = targets(sizes)
    for r in found.itertuples():
        assert abs(r.target - wanted[source[r.doc_id]]) < 1e-6 * r.target and r.source_size == sizes[source[r.doc_id]]
    for s, t in wanted.items():
        assert abs(takes[s] - t) <= 45 + 0.01 * t
    assert sum(takes.values()) <= sum(sizes.values())


def test_mix_takes_rows_of_one_id_apart(documents):
    draw = random.Random(18)
    rows = [(draw.choice([7, None, i, i]), "w " * draw.choice([0, 1, 40, 900]) + f"t{i}", draw.choice("abc")) for i in range(300)]
    taken = {}
    for r in mix_sources(documents(rows)).collect():
        taken[r.doc_id, r.size] = taken.get((r.doc_id, r.size), 0) + r.taken
    given = {}
    for r in mixed_documents(documents(rows)).collect():
        key = r.doc_id, len(r.text.split())
        given[key] = given.get(key, 0) + key[1]
    assert given == {k: n for k, n in taken.items() if n}
    assert mixed_documents(documents([])).count() == 0


def test_mix_odd_rows(documents):
    found = mix_sources(documents(ODD)).toPandas()
    assert len(found) == len(ODD) and found[found["size"] == 0].taken.sum() == 0
    assert mix_sources(documents([])).count() == 0
    assert mix_sources(documents([(1, None, None), (2, "", "a")])).toPandas().taken.tolist() == [0, 0]


def test_token_counts_agree_with_the_library(documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    draw = random.Random(1)
    parts = [" the", "it's", " 12", "\n\n", "  ", "é", "ß", "<|endoftext|>", " …", "\t", "�", "日", "x1", "'LL", "'ll", " qzx"]
    rows = ODD + [(100 + i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 60))), "r") for i in range(150)]
    found = token_counts(documents(rows), BPE).collect()
    wanted = sorted((i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in found) == wanted
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)
    assert token_counts(documents([]), BPE).count() == 0


def test_token_counts_remember_a_bounded_number_of_characters(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr("recordweave.llm.token_counts.REMEMBERED_CHARS", 1000)
    library, draw = Tokenizer.from_file(BPE), random.Random(2)
    pattern = split_pattern(class_ranges(library))
    counter = Counter(library.to_str(), pattern, prove_whole_tokens(library, pattern))
    for _ in range(20):
        texts = ["".join(draw.choice("qzxvj") for _ in range(draw.randint(1, 400))) for _ in range(3)]
        assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert sum(map(len, counter.merged)) == counter.chars <= 1200  # one call's own strings at most, or the bound


@pytest.mark.parametrize(
    ("part", "key", "value"),
    [("model", "type", "Unigram"), ("model", "end_of_word_suffix", "</w>"), ("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "type", "Metaspace"), (None, "normalizer", {"type": "NFC"})],
)
def test_token_counts_refuse_other_layouts(part, key, value):
    spec = json.loads(Path(BPE).read_text())
    check_layout(json.dumps(spec))
    (spec[part] if part else spec)[key] = value
    with pytest.raises(ValueError, match="token_counts can't count"):
        check_layout(json.dumps(spec))


def test_repeat_words_against_brute_force():
    draw = random.Random(3)
    for _ in range(200):
        words = [draw.choice(b"abcd"[: draw.randint(1, 4)]) for _ in range(draw.randint(0, 30))]
        seen, cover = {}, set()
        for i in range(len(words) - 2):
            seen.setdefault(tuple(words[i : i + 3]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                cover |= {i + k for i in places for k in range(3)}
        assert repeat_words(words) == len(cover)


def prose(draw, n):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(n))


def test_frequent_lines_and_depleted_documents(documents):
    draw = random.Random(5)
    menu = prose(draw, 40)
    rows = [(i, f"{menu}\n{prose(draw, 60)}", "h") for i in range(30)]  # a shared line, most of the text is their own
    rows += [(100 + i, f"{menu}\n{prose(draw, 12)}", "h") for i in range(5)]  # little but the shared line
    rows += [(200 + i, f"{menu}\n{prose(draw, 12)}", "quiet") for i in range(5)]  # too few on their host
    rows += [(300 + i, prose(draw, 1).join(["\n"] * 2) + "same text " + " ".join(map(str, range(60))), "copies") for i in range(1)] * 40  # copies count once
    found = {r.doc_id: r for r in line_quality(documents(rows)).collect()}
    assert all(found[i].kept and found[i].n_removed_words == 40 for i in range(30))
    assert all(not found[100 + i].kept and not found[100 + i].base_failed for i in range(5))
    assert all(found[200 + i].kept and found[200 + i].n_removed_words == 0 for i in range(5)) and found[300].kept
    cleaned = {r.doc_id: r for r in clean_documents(documents(rows)).collect()}
    assert menu not in cleaned[3].text and cleaned[3].n_chars == len(cleaned[3].text) and 101 not in cleaned and menu in cleaned[201].text
    assert cleaned[3].h == 7


def test_rows_are_cleaned_alone_whatever_their_ids(documents):
    draw = random.Random(17)
    menu, good = prose(draw, 40), [prose(draw, 60) for _ in range(4)]
    rows = [(None, good[0], "s"), (None, "junk", "s"), (7, good[1], "s"), (7, "junk " * 90, "s"), (8, f"{menu}\n{good[2]}", "s"), (8, f"{menu}\n{good[3]}", "quiet")]
    rows += [(100 + i, f"{menu}\n{prose(draw, 60)}", "s") for i in range(30)]
    found = [(r.doc_id, r.text) for r in clean_documents(documents(rows)).collect() if r.doc_id is None or r.doc_id < 100]
    assert sorted(found, key=str) == sorted([(None, good[0]), (7, good[1]), (8, good[2]), (8, f"{menu}\n{good[3]}")], key=str)


def test_near_copies_do_not_condemn_their_lines(documents):
    draw = random.Random(15)
    lines = [prose(draw, 12) for _ in range(10)]
    rows = []
    for i in range(120):  # each has one word of one line changed
        at = draw.randrange(10)
        words = lines[at].split()
        words[draw.randrange(12)] = f"edit{i}"
        rows.append((i, "\n".join([*lines[:at], " ".join(words), *lines[at + 1 :]]), "s"))
    menu = prose(draw, 40)
    rows += [(500 + i, f"{menu}\n{prose(draw, 60)}", "s") for i in range(60)]  # a line of independent documents
    found = {r.doc_id: r for r in line_quality(documents(rows)).collect()}
    assert all(found[i].kept and found[i].n_removed_words == 0 for i in range(120))
    assert all(found[500 + i].kept and found[500 + i].n_removed_words == 40 for i in range(60))
    cleaned = {r.doc_id: r.text for r in clean_documents(documents(rows)).collect()}
    assert all(cleaned[i] == t for i, t, _ in rows[:120]) and not any(menu in t for t in cleaned.values())


def test_line_limit_follows_the_host(documents):
    draw = random.Random(16)
    menu = prose(draw, 9)
    rows = [(i, f"{menu}\n{prose(draw, 60)}", "s") for i in range(30)]
    small = line_quality(documents(rows)).where("n_removed_words > 0").count()
    large = line_quality(documents(rows + [(100 + i, f"own line {i}", "s") for i in range(40_000)])).where("n_removed_words > 0").count()
    assert (small, large) == (30, 0)


def test_line_quality_odd_rows(documents):
    found = line_quality(documents(ODD)).collect()
    assert len(found) == len(ODD) and all(r.base_failed and not r.kept for r in found if r.n_words < 50)
    assert line_quality(documents([])).count() == 0 and clean_documents(documents([])).count() == 0


def labelled(n):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        lines = [(" ".join(w.upper() + "!!" for w in prose(draw, 12).split()) if bad else prose(draw, 12).capitalize() + ".") for _ in range(draw.randint(1, 6))]
        rows.append((i, "\n".join(lines), "s"))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_classifier_on_held_out_documents(spark, documents):
    rows, labels = labelled(300)
    found = quality_scores(documents(rows + [(None, "x", "s"), (900, None, "s"), (901, "", "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    right = {i: q for i, q, _ in labels}
    held = [r for r in found if r.held_out and r.doc_id in right]
    assert len(found) == 303 and len(held) > 30 and sum(r.predicted == right[r.doc_id] for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_classifier_without_labels_or_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality_scores(documents([(1, "a", "s")]), none).collect()] == [0.5]
    assert quality_scores(documents([]), none).count() == 0


def test_pieces_agree_with_sentencepiece(documents):
    import sentencepiece

    with open(PIECES, "rb") as f:
        data = f.read()
    model = read_model(data)
    verify_parity(rebuild(model), data)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    draw = random.Random(2)
    parts = ["a", " ", "  ", "ing", "é", "😀", "\n", "▁", "Th", "the ", "\x00", "1"]
    rows = ODD + [(100 + i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 40))), "r") for i in range(200)] + [(500 + i, p, "p") for i, p in enumerate(PROBES)]
    encoded = decode(encode(documents(rows), PIECES), PIECES).collect()
    assert len(encoded) == len(rows)
    for r in encoded:
        assert (r.ids is None and r.decoded is None) if r.text is None else (r.ids == library.encode(r.text) and r.decoded == library.decode(r.ids))
    assert piece_report(documents([]), PIECES).count() == 0


def test_last_stage_decodes_too(spark, documents):
    import corpus_pipeline

    rows = [(1, "plain words, and a naïve 日本 😀", "s"), (2, "holds the marker ▁ itself", "s"), (3, None, "s"), (4, "", "s")]
    found = {r.doc_id: r.round_trip for r in corpus_pipeline.STAGES[-1][1](spark, documents(rows), "").collect()}
    assert found == {1: True, 2: False, 3: True, 4: True}


def test_piece_report_against_sentencepiece(documents):
    import hashlib

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    draw = random.Random(31)
    parts = ["the ", "ing", "é", "😀", "\n", "▁", " ", "\x00", "日本", "x" * 40]
    rows = ODD + [(100 + i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 30))), "r") for i in range(100)]
    wanted = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        wanted.append((str(i), len((t or "").encode()), len(ids), sum(map(library.is_byte, ids)), hashlib.sha256(packed).hexdigest(), library.decode(ids) == (t or "")))
    found = [(str(r.doc_id), r.n_bytes, r.n_tokens, r.n_byte_tokens, r.ids_sha256, r.round_trip) for r in piece_report(documents(rows), PIECES).collect()]
    assert sorted(found) == sorted(wanted)


def test_long_texts_are_encoded_in_parts(monkeypatch):
    from recordweave.llm import pieces

    _, tokenizer = pieces._load(PIECES)
    draw = random.Random(32)
    texts = ["".join(draw.choice(["ab ", "  ", "c", "\n", "▁▁", "longword "]) for _ in range(400)) for _ in range(5)] + ["x" * 500, " " * 200, ""]
    whole = pieces.Encoder(tokenizer.to_str()).encode(texts)
    monkeypatch.setattr(pieces, "CALL", 50)
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    assert pieces.Encoder(tokenizer.to_str()).encode(texts) == whole


def message(*parts):
    """A protobuf message of (number, value) fields."""
    import struct

    out = b""
    for number, value in parts:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += bytes([number << 3, value])
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_unigram_models_agree_with_sentencepiece():
    import sentencepiece

    scored = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("a", -2.0, 1), ("ab", -1.0, 1), ("b", -2.5, 1), ("▁a", -1.5, 1), ("bab", -2.2, 1), ("▁abb", -4.1, 1)]
    pieces = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in scored)
    data = pieces + message((2, message((3, 1)))) + message((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    library, tokenizer = sentencepiece.SentencePieceProcessor(model_proto=data), rebuild(read_model(data))
    draw = random.Random(33)
    for text in ["", "ab", "abb ab", *("".join(draw.choice("aab b") for _ in range(draw.randint(1, 20))) for _ in range(300))]:
        assert tokenizer.encode(text, add_special_tokens=False).ids == library.encode(text), text


def test_marginals_and_gradient_against_enumerated_chains():
    import itertools

    import numpy as np

    from recordweave.llm.line_crf import Chains, neighbours, sigmoid, slope

    draw = np.random.default_rng(4)
    doc = np.repeat(np.arange(4), [1, 4, 2, 3])
    x, y, weight = draw.standard_normal((10, 5)), draw.integers(0, 2, 10).astype(float), np.repeat([0.7, 1.3, 1.0, 0.4], [1, 4, 2, 3])
    chains, later = Chains(doc), np.flatnonzero(neighbours(doc)[0])

    def enumerated(p):
        loss, good = 0.0, np.zeros(10)
        for d in range(4):
            at = np.flatnonzero(doc == d)
            emit, t = x[at] @ p[:-4], p[-4:]
            score = lambda s: sum(e for e, k in zip(emit, s) if k) + sum(t[2 * a + b] for a, b in zip(s, s[1:]))  # noqa: B023, E731, B905
            every = list(itertools.product((0, 1), repeat=len(at)))
            mass = np.exp([score(s) for s in every])
            good[at] = (mass[:, None] * np.array(every)).sum(0) / mass.sum()
            loss += weight[at[0]] * (np.log(mass.sum()) - score(y[at].astype(int).tolist()))
        return loss, good

    p = draw.standard_normal(9)
    gradient, odds = slope(p, x, y, weight, chains, later)
    assert np.allclose(sigmoid(odds), enumerated(p)[1])
    for k in range(len(p)):
        step = np.eye(len(p))[k] * 1e-6
        assert abs((enumerated(p + step)[0] - enumerated(p - step)[0]) / 2e-6 - gradient[k]) < 1e-6


def test_line_labels_differ_inside_documents(spark, documents):
    from recordweave.llm.line_crf import line_scores

    rows, labels = labelled(300)
    draw = random.Random(34)
    good = lambda: prose(draw, 12).capitalize() + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in prose(draw, 12).split())
    for i in range(300, 420):  # good documents with a line of junk, bad ones with a good line
        mine, other = (good, bad) if i % 2 else (bad, good)
        lines = [mine() for _ in range(7)]
        lines.insert(draw.randrange(8), other())
        rows.append((i, "\n".join(lines), "s"))
        labels.append((i, i % 2, 0))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts = {i: t.split("\n") for i, t, _ in rows}
    found = line_scores(documents(rows), table).collect()
    right = [(r.good > 0.5) == ("!!" not in texts[r.doc_id][r.line]) for r in found]
    assert len(found) == sum(map(len, texts.values())) and sum(right) / len(right) > 0.95
    scores = {r.doc_id: r for r in quality_scores(documents(rows), table).collect()}
    assert all(scores[i].predicted == q for i, q, _ in labels)


@pytest.mark.parametrize("piece", [1 << 20, 7, 3])
def test_line_features_do_not_depend_on_pieces(monkeypatch, piece):
    import numpy as np

    from recordweave.llm import line_crf

    texts = [t.encode() for t in ["a b b c!\nx\n\n x x y? \n", "", " \n", "zz |\nzz |\nq", "é " * 5, "word\n" * 40 + "longerword " * 9]]
    whole = line_crf.Lines().own(texts)
    monkeypatch.setattr(line_crf, "PIECE", piece)
    assert all(np.array_equal(a, b) for a, b in zip(whole, line_crf.Lines().own(texts), strict=True))
    assert whole[1].tolist()[:4] == [0, 1, 3, 0]


def test_snapshots_collapse(spark):
    rows = []
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", None)]
    for conv, n in ((1, 4), (2, 2), (3, 3), (4, 4)):  # 4 equals 1; 2 and 3 are snapshots
        rows += [(conv, t, r, x, "extra") for t, (r, x) in enumerate(talk[:n])]
    rows += [(5, 0, "user", "hi", "e"), (5, 1, "assistant", "other", "e"), (6, 0, "user", "hi", "e"), (None, 0, "user", "q", "e"), (7, None, "user", "z", "e"), (7, None, "user", "z", "e")]
    rows += [(8, t, "user", f"m{t}", "e") for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    found = {(r.conv_id, r.part): r for r in format_conversations(df).collect()}
    assert {c for c, _ in found} == {1, 5, 7, 8} and [found[8, p].n_turns for p in range(3)] == [256, 256, 88]
    assert found[1, 0].rendered.startswith("<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n") and found[7, -1].n_turns == 2
    assert format_conversations(df.limit(0)).count() == 0



@pytest.mark.parametrize("text", [None, "", "a b"])
def test_word_count(spark, text):
    from pyspark.sql import functions as F

    from recordweave.llm.common import word_count

    assert spark.createDataFrame([(text,)], "t string").select(word_count(F.col("t"))).first()[0] == len((text or "").split())
