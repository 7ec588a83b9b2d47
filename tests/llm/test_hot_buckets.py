"""Near duplicates in buckets that are cut into many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from recordweave.llm import near_duplicates as nd

from .test_search_operators import brute_components


@pytest.mark.parametrize(("signatures", "sets", "families"), [(4, 3, 1), (7, 2, 3), (1, 1, 2)])
def test_small_blocks_lose_no_link(documents, monkeypatch, signatures, sets, families):
    monkeypatch.setattr(nd, "SIGNATURE_BLOCK", signatures)
    monkeypatch.setattr(nd, "BLOCK", sets)
    draw = random.Random(families)
    rows = []
    for f in range(families):
        words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(100)]
        for _ in range(70):
            own = list(words)
            for _ in range(draw.randint(0, 6)):
                own[draw.randrange(100)] = f"w{draw.random()}"
            rows.append((len(rows), " ".join(own), "s"))
    wanted = brute_components(rows, 4)
    found = nd.near_duplicates(documents(rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
    assert len({c for _, c in wanted.values()}) > families


def test_a_large_component_is_not_paired_with_itself(spark):
    """Of m members of one component and three strangers the work is m rows for a block of strangers, not m times its blocks."""
    members = spark.range(1003).selectExpr("7L as bucket", "0 as band", "id as cid", "case when id < 1000 then 0L else id end as label", "10L as n_shingles")
    def work(rows, needed, percent):
        return [(r[5], len(rows)) for r in rows]

    payload = members.selectExpr("cid", "binary('x') as signature")
    dealt = nd._block_tasks(members, payload, lambda c: F.ceil(F.count_if(c) / 100), work, ["cid", "size"], 80).collect()
    seen = [r.cid for r in dealt]
    assert sorted(c for c in seen if c < 1000) == list(range(1000))
    assert sorted(seen.count(c) for c in (1000, 1001, 1002)) == [11, 11, 11]  # each of ten blocks, and their own
