import duckdb

from ledgerloom.llm.queries import ORACLE, QUERIES


def test_mixing_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
        want = con.sql(sql).df().sort_values("doc_id").reset_index(drop=True)
        assert got.equals(want[got.columns.tolist()])
