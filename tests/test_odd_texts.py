"""Registered queries against their SQL on texts that the test tables lack."""

from oracle import check

import duckdb
from keepsake.plans import catalogue


def test_citations_and_verdicts(spark, tmp_path):
    texts = ["maybe noñar", "ciónosci no", "éyes", "noé, yes", "yes_no no", "[ep_abcdef12] twice [ep_abcdef12]", "", None]
    rows = [(4 * i + 3, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    check(spark, con, str(tmp_path), catalogue.queries()["citations_and_verdicts"], catalogue.oracle_sql()["citations_and_verdicts"])
