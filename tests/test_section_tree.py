"""Headings with odd blanks, digits and line ends, held against the SQL."""

import duckdb

from quarry.plans.jobs import QUERIES, SQL

LINES = ("#\nnext", "#\ttab\t", "#\xa0hard", "#  \xa0hard　", "## 1.2 　wide ", "# ١ digit", "# 5.1a\tFirst", "##\x0bno", "# \x85a", "### 2\r", "# \x1cx", "######### nine", "######## Annex", "##\r\n# z")


def test_section_tree_of_odd_headings(spark, tmp_path):
    rows = [(i, f"{x}\n" * 2 + " ".join(LINES[i:])) for i, x in enumerate(LINES)] + [(90, "\n".join(LINES)), (91, ""), (92, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(SQL["section_tree"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["section_tree"](spark, str(tmp_path)).collect()) == sorted(want)
