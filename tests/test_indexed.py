"""The indexed search builds its index over all files."""

from glyphmill.plans import queries

SF = "/root/testdata/sf0.001"


def test_search_indexed_covers_all_files(spark, monkeypatch):
    seen, trigrams = [], queries.index.trigrams
    monkeypatch.setattr(queries.index, "trigrams", lambda files: seen.append(files.count()) or trigrams(files))
    columns = ["path", "line_num", "line_text", "score"]
    got = sorted(map(tuple, queries.search_indexed(spark, SF).select(columns).collect()))
    assert seen == [spark.read.parquet(f"{SF}/documents.parquet").count()]
    assert got == sorted(map(tuple, queries.search.search(queries._files(spark, SF), "tion", 10**6).select(columns).collect()))
