"""Base columns of quality rules and private data against their SQL, on odd texts."""

import random

import duckdb
import pytest

from recordweave.llm import queries

WORDS = ["a", "b", "c", "a@b.c", "x.y@z-1.de.", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+49 (30) 123-456", "+1", "+12345678901234567", "é#ü", "$|<>", "日本"]


def texts(seed):
    draw = random.Random(seed)
    for _ in range(120):
        n = draw.choice([0, 1, 2, 3, 4, 20, 80, 200])
        yield "".join(draw.choice(WORDS) + draw.choice([" ", " ", "\n", "\n", "\t", "", "\r\n", "\x0b", " "]) for _ in range(n))
    for _ in range(20):
        line = " ".join(draw.choice(WORDS) for _ in range(4))
        yield "\n".join([line] * draw.choice([1, 2, 30]))
    yield from [None, "", " \n\t", "\n", "#" * 9, "a@b.c" * 3, "+1234567" * 4, "4" * 40]


@pytest.mark.parametrize("name", ["line_quality_base", "private_data_base"])
def test_base_columns_equal_sql(spark, tmp_path, name):
    rows = [(i % 100 if i % 7 else None, t, f"s{i % 3}") for i, t in enumerate(texts(name))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, wanted.fetchall()))
