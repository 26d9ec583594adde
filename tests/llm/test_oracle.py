"""The queries of this subpackage against their SQL, on the smallest tables and on planted secrets."""

import random

import pytest

from replisift.llm import oracle as sql
from replisift.llm import queries, secrets
from tests import oracle
from tests.llm.test_secrets import TRICKY, tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert oracle.same(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE_SQL[name])


def test_battery(spark, tmp_path):
    rng = random.Random(3)
    part = lambda: rng.choice([next(tokens(rng, 1)), "station", f'token = "{next(tokens(rng, 1))}"', "x" * 30, "haupt-bahn_hof/nation-al/thing-one", f"{rng.getrandbits(160):040x}"])
    rows = [(k, " ".join(part() for _ in range(rng.randrange(1, 9)))) for k in range(200)] + [(1000 + k, t) for k, t in enumerate(TRICKY)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    scanned = secrets.scan_secrets(docs)
    assert oracle.same(scanned, con, sql.SECRETS) and scanned.where("spans LIKE '%random%'").count() > 50
