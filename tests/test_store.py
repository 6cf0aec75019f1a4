"""One file a document: a small table's files are made by many tasks, one file for each document."""

from ledgerspark.sources import store


def test_files_of_one_partition_are_made_by_many_tasks(spark, tmp_path):
    csv = spark.range(40).selectExpr("id AS doc_id", "concat('row ', id) AS csv").coalesce(1)
    twice = csv.unionByName(spark.createDataFrame([(7, "again"), (None, "without id")], "doc_id long, csv string"))
    store.write_csv_per_document(twice, f"file://{tmp_path}/csv")
    files = list((tmp_path / "csv").glob("doc_id=*/*.txt"))
    assert len({f.name.split("-")[1] for f in files}) > 4
    assert len(files) == len({f.parent for f in files}) == 41
    want = {f"doc_id={k}": [f"row {k}"] for k in range(40)} | {"doc_id=7": ["again", "row 7"], "doc_id=__HIVE_DEFAULT_PARTITION__": ["without id"]}
    assert {f.parent.name: sorted(f.read_text().splitlines()) for f in files} == want
