"""Archives out of parts open with a standard reader, however many files one has."""

import random
import zipfile

from pyspark.sql import functions as F

from docforge.sources.archives import archive_parts, end_of, write_archives
from docforge.sources.tables import read_pages


def test_archives_open(spark, tmp_path):
    rng = random.Random(4)
    files = [("large" if i % 5 else "small", rng.choice(["a.txt", "b", "dir/ü.md", f"own{i}.txt"]), None if i % 97 == 0 else f"{i} " * (i % 50), i) for i in range(12_000)]
    df = spark.createDataFrame(files, "archive string, name string, content string, place bigint").repartition(5, "place")
    done = write_archives(archive_parts(df, order="place"), f"file://{tmp_path}/zips").collect()
    assert sorted(r.archive for r in done) == ["large", "small"]
    for r in done:
        mine = [(n, c or "") for a, n, c, _ in files if a == r.archive]
        with zipfile.ZipFile(r.path) as z:
            assert z.testzip() is None
            names = z.namelist()
            assert len(names) == len(set(names)) == len(mine)
            assert [z.read(n).decode() for n in names] == [c for _, c in mine]
            assert names[0] == mine[0][0] and sum(n.startswith("a") and n.endswith(".txt") for n in names) == sum(n == "a.txt" for n, _ in mine)


def test_an_archive_of_many_files(spark, tmp_path):
    """More files than two bytes count: the directory's end has its longer form."""
    df = spark.range(70_000).select(F.lit("many").alias("archive"), F.concat(F.lit("f"), "id").alias("name"), F.col("id").cast("string").alias("content"), F.col("id").alias("order"))
    (row,) = write_archives(archive_parts(df), f"file://{tmp_path}/zips").collect()
    with zipfile.ZipFile(row.path) as z:
        assert len(z.namelist()) == 70_000 and z.read("f69999") == b"69999"
    assert len(end_of(10, 1 << 33, 100)) == 98 and len(end_of(10, 100, 100)) == 22


def test_pages_of_lists_and_of_objects(spark, tmp_path):
    for name, text in (("a.json", '[{"page_num": 1, "text": "x"}]'), ("b.json", ' {"pages": [{"page_num": 2, "text": "y"}, {"page_num": 3, "text": null}]}')):
        (tmp_path / name).write_text(text)
    assert sorted((r.page_num, r.text or "") for r in read_pages(spark, f"file://{tmp_path}/*.json").collect()) == [(1, "x"), (2, "y"), (3, "")]
