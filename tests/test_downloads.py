"""Downloads kept as rows."""

from __future__ import annotations

from collections import Counter

from folioforge.sources import payloads


def test_downloads_as_rows(spark):
    rows = spark.createDataFrame([(1, b"a" * 5), (2, b"a" * 6), (3, None), (4, b"")], "id long, content binary")
    got = {r.id: (r.length, r.name) for r in payloads.downloads(rows, 5).collect()}
    assert set(got) == {1, 4} and got[1][0] == 5 and got[4][0] == 0 and len(got[1][1]) == 16


def test_files_are_still_read(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * (i + 4))
    got = payloads.images(spark, str(tmp_path), 5, "*.txt").collect()
    rows = payloads.downloads(spark.createDataFrame([(b"x" * 4,), (b"x" * 5,), (b"x" * 6,)], "content binary"), 5).collect()
    assert Counter((r.length, r.name) for r in got) == Counter((r.length, r.name) for r in rows)


def test_downloaded_files_make_no_folder_for_each_page(spark, tmp_path):
    from folioforge.plans.page_queries import downloaded_files

    plan = downloaded_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "pages.parquet" in plan
