from pathlib import Path

import duckdb
import pytest

from veloframe.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())
    if name in queries.SQL:
        con = duckdb.connect()
        for f in Path(DATA).glob("*.parquet"):
            con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
        cur = con.execute(queries.SQL[name])
        names = [d[0] for d in cur.description]
        at = [names.index(c) for c in sorted(df.columns)]
        assert rows == sorted(str([r[i] for i in at]) for r in cur.fetchall())
    else:
        assert rows or name in ("p9_found", "p9_validation")


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_ids_of_the_test_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.p7_ids(spark, DATA)
    assert got.columns == ["doc_id", "ids"] and dict(got.dtypes)["ids"] == "array<int>"
    assert {r.doc_id: r.ids for r in got.collect()} == {k: t.encode(v, add_special_tokens=False).ids for k, v in texts.items()}
