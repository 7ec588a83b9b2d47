"""Vector codes, the prefix trie and shards against brute force, on odd tables and on hot keys."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from recordweave.llm.sharding import rendezvous, shard_records, shard_report, write_shards
from recordweave.llm.trie import ordered_turns, prefix_trie, rebuilt_trie
from recordweave.llm.vector_codes import compress_vectors, decode_codes, encode_vectors, fit_codebooks, nearest_entries, usable


def full_search(x, book):
    far = ((x[:, None, :] - book[None]) ** 2).sum(2)
    return far.argmin(1), far.min(1)


@pytest.mark.parametrize("width", [1, 2, 4, 7, 33])
def test_partial_distances_give_the_full_search_with_ties(width):
    rng = np.random.default_rng(width)
    for spread in (2, 1000):
        x, book = rng.integers(-spread, spread, (700, width)), rng.integers(-spread, spread, (64, width))
        book[40] = book[3]
        for a, b in zip(nearest_entries(x, book), full_search(x, book), strict=True):
            assert (a == b).all()


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(y is not None and math.isfinite(y) for y in v)]
    x = {n: np.array([math.floor(256 * y) for y in v]).reshape(parts, -1) for n, (_, v, _) in enumerate(kept)}
    first = sorted(range(len(kept)), key=lambda n: kept[n][0])[:entries]
    books = np.array([[x[n][p] for n in first] for p in range(parts)])
    for k in range(rounds + 1):
        found = {n: [full_search(x[n][p][None], books[p]) for p in range(parts)] for n in x}
        if k < rounds:
            for p in range(parts):
                held = defaultdict(list)
                for n in x:
                    held[int(found[n][p][0][0])].append(x[n][p])
                for e, own in held.items():
                    books[p][e] = [int(s) // len(own) for s in np.sum(own, 0)]
    error = {n: sum(int(f[1][0]) for f in found[n]) for n in x}
    of = Counter()
    for n, (_, _, label) in enumerate(kept):
        of[label] += error[n]
    sha = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    return sorted((i, "".join(f"{int(f[0][0]):02x}" for f in found[n]), error[n], of[label], sha) for n, (i, _, label) in enumerate(kept))


def test_codes_equal_brute_force_with_nulls_ties_and_odd_components(spark):
    rng = random.Random(5)
    rows = [(i, [round(rng.gauss(0, 0.4), 3) for _ in range(32)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(200 + i, list(rows[i % 3][1]), 1) for i in range(40)]  # equal vectors
    rows += [(300, None, 1), (301, [None] * 32, 1), (302, [float("nan")] * 32, 2), (303, [float("inf")] + [0.0] * 31, 2), (304, [], 2), (305, [-0.001] * 32, None)]
    table = spark.createDataFrame([(i, v, label, 7) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code int")
    got = compress_vectors(table).collect()
    as_float = [(i, None if v is None else [None if y is None else float(np.float32(y)) for y in v], label) for i, v, label in rows if v != []]
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(as_float)


def test_codes_of_few_rows_and_none(spark):
    kind = "vec_id long, embedding array<double>, label string"
    assert compress_vectors(spark.createDataFrame([], kind)).collect() == []
    got = compress_vectors(spark.createDataFrame([(1, [0.5] * 16, "a"), (1, [0.25] * 16, None), (None, [0.5] * 16, "a")], kind)).collect()
    assert [r.error for r in got] == [0, 0, 0] and {r.label_error for r in got} == {0}


def test_decoding_gives_the_entries_back(spark):
    table = spark.createDataFrame([(i, [float(i)] * 4) for i in range(8)], "vec_id long, embedding array<double>")
    kept, dim = usable(table, "embedding", 2, 256)
    books = fit_codebooks(kept, dim, "vec_id", "embedding", parts=2, entries=8, rounds=1)
    got = decode_codes(encode_vectors(kept, books), books).collect()
    assert {r.vec_id: r.decoded for r in got} == {i: [float(i)] * 4 for i in range(8)}


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            content = (role or "", text or "")
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(content[0])}:{content[0]}{content[1]}".encode()).digest(), content))
    turns = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members[n]) - 1) * len(n[-1][1]) if n else 0
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in sorted(c for c in members[n] if len(built[c]) == len(n))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], ends(n)) for n, m in members.items())


def of_trie(df):
    return sorted(tuple(r) for r in df.collect())


KIND = "conv_id long, turn long, role string, text string"


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in list(range(0, 160)) + [250, 251, 1007]:
        for turn in range(rng.choice([1, 1, 2, 3, 8])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["a", "b", "long ä text"])))
    rows += [(5, None, None, None), (5, None, "user", ""), (6, 1, "user", "tie"), (6, 1, "user", "tie"), (6, 1, "x", "tie"), (None, 0, "user", "nobody"), (99, 1 << 40, "user", "far")]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], KIND + ", node int, depth int")
    assert of_trie(rebuilt_trie(table)) == brute_trie(rows)


def test_trie_of_one_long_conversation_and_many_copies(spark):
    rows = [(300 + i, 0, "user", "same") for i in range(90)]
    rows += [(500, t, "user", f"t{t % 7}") for t in range(700)] + [(700, t, "user", f"t{t % 7}") for t in range(650)]
    got = of_trie(rebuilt_trie(spark.createDataFrame(rows, KIND)))
    assert got == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert of_trie(rebuilt_trie(spark.createDataFrame([], KIND))) == []
    turns = ordered_turns(spark.createDataFrame([], KIND))
    members = spark.createDataFrame([(7, 0), (3, 0)], "conv_id long, n long")
    assert of_trie(prefix_trie(turns, members)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]


def test_ends_of_many_chunks_are_hashed_in_order(spark):
    ids = [-70_000, -1, 0, 5, 65_535, 65_536, 1_000_000]
    turns = spark.createDataFrame([(i, 1, "m", 2) for i in ids], "conv_id long, position long, content string, chars long")
    members = spark.createDataFrame([(i, 1) for i in ids], "conv_id long, n long")
    leaf = [r for r in prefix_trie(turns, members).collect() if r.depth == 1]
    assert [r.ends_sha256 for r in leaf] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]


def test_shards_keep_their_law_on_odd_rows(spark, documents):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "ä" * 9, "x" * 100]), "s") for i in range(3000)] + [(None, "a", "s")] * 500 + [(7, None, "s"), (7, "", "s")] * 3
    got = shard_report(documents(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        of[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    assert all(len(s) == 1 for s in of.values())
    moved = sum(r.grown_shard == 16 and r.doc_id is not None for r in got)
    assert 100 < moved < 260  # a seventeenth of 3000 is 176
    assert shard_report(documents([])).collect() == []


def test_weights_share_the_keys_and_a_removed_shard_moves_its_own_only(spark):
    keys = spark.range(20_000)
    three = {r.id: r.s for r in keys.select("id", rendezvous(keys.id, (1.0, 2.0, 5.0)).alias("d")).selectExpr("id", "array_min(d).shard as s").collect()}
    share = Counter(three.values())
    assert abs(share[0] - 2500) < 250 and abs(share[1] - 5000) < 350 and abs(share[2] - 12_500) < 400
    two = {r.id: r.s for r in keys.select("id", rendezvous(keys.id, (1.0, 2.0)).alias("d")).selectExpr("id", "array_min(d).shard as s").collect()}
    assert all(two[i] == s for i, s in three.items() if s != 2)
    with pytest.raises(ValueError):
        rendezvous(keys.id, (1.0, 0.0))


def test_slots_are_the_same_in_other_partitions_and_hot_keys_are_spread(spark):
    rows = spark.range(5000).selectExpr("case when id < 2000 then 1 else id end as k", "cast(id % 50 as int) as v", "1 as slot", "2 as __row")
    a = shard_records(rows.repartition(7), "k", ties=("v",)).select("k", "v", "shard", "slot").collect()
    b = shard_records(rows.repartition(2), "k", ties=("v",)).select("k", "v", "shard", "slot").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_written_shards_are_folders_in_slot_order(spark, documents, tmp_path):
    docs = documents([(i, f"text {i}", "s") for i in range(300)])
    write_shards(docs, str(tmp_path / "out"), weights=(1.0, 1.0))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1]
