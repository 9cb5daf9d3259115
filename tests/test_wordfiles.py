"""Word list files: headers, order of lines over files, and the data source."""

import pytest

from hibiki.sources import tidysource, wordlist

HEADER = "id,original,surface , status"


@pytest.fixture()
def folder(tmp_path):
    """Two files, the later one by name much larger, with lines that look like the header."""
    a = [HEADER, "1,x,y ,current", "", HEADER, "2, a b ,c", "3,d,e, old , more", "4,日本,f,current"]
    b = [HEADER, *(f"{i},o{i},s{i},{'current' if i % 3 else 'old'}" for i in range(10, 900))]
    (tmp_path / "a.csv").write_text("﻿" + "\r\n".join(a), encoding="utf-8")
    (tmp_path / "b.csv").write_text("\n".join(b) + "\n", encoding="utf-8")
    (tmp_path / "_skip").write_text("no")
    return tmp_path, a, b


def test_headers_go_once_a_file(spark, folder):
    path, a, b = folder
    rows = wordlist.read_tidy(spark, str(path)).sort("seq").collect()
    assert [r.seq for r in rows[:5]] == [1, 3, 4, 5, 6] and rows[1].asDict() == {"seq": 3, "id": "id", "original": "original", "surface": "surface", "status": "status"}
    assert [r.id for r in rows[5:]] == [str(i) for i in range(10, 900)] and rows[5].seq == len(a) + 1
    assert (rows[0].surface, rows[2].original, rows[2].status, rows[3].status, rows[4].original) == ("y", "a b", None, "old", "日本")


def test_lines_keep_their_order_in_splits(spark, folder):
    path, a, b = folder
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = wordlist.read_lines(spark, str(path)).sort("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.seq for r in rows] == list(range(len(a) + len(b))) and [r.line for r in rows] == [*range(len(a)), *range(len(b))]
    assert [r.value.removeprefix("﻿") for r in rows] == a + b


@pytest.mark.parametrize("split", [1 << 20, 2_311])
def test_data_source(spark, folder, split):
    path, a, _ = folder
    tidysource.register(spark)
    read = lambda **o: spark.read.format("tidy_words").options(splitBytes=split, **o).load(str(path))
    got = read()
    assert got.columns == ["file", "offset", "id", "original", "surface", "status"]
    want = [(r.id, r.original, r.surface, r.status) for r in wordlist.read_tidy(spark, str(path)).sort("seq").collect()]
    assert [tuple(r)[2:] for r in got.sort("file", "offset").collect()] == want
    for query in ("status = current", "status != current and id ~= 1", "( status = old or id = 12 ) and surface !~= s3", "nothing = 1", "broken", "status ~= o"):
        mine = sorted(tuple(r) for r in read(where=query, columns="id,surface").collect())
        assert mine == sorted((r.id, r.surface) for r in wordlist.read_tidy(spark, str(path), query).collect()), query


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert wordlist.read_tidy(spark, str(tmp_path / "e.csv")).collect() == []
    (tmp_path / "e.csv").write_text(HEADER)
    tidysource.register(spark)
    got = spark.read.format("tidy_words").load(str(tmp_path / "e.csv"))
    assert got.columns[2:] == ["id", "original", "surface", "status"] and got.collect() == []
    with pytest.raises(Exception, match="missing"):
        spark.read.format("tidy_words").load(str(tmp_path / "missing")).collect()


def test_rows_are_numbered_by_one_reading_of_a_sampled_sort(spark):
    from hibiki.sources.wordlist import with_row_index

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(0, 300_000, 1, 8).selectExpr("id * 7919 % 300000 AS k").sort("k")
        assert with_row_index(rows, "n").where("n <> k").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
