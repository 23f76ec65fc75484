import pytest

from stateweave.sources import databases, files
from stateweave.sources.databases import Partitioning

STORE = {"type": "postgresql", "host": "db", "port": 5432, "database": "reg", "username": "u", "password": "p"}


def test_query_scan_options():
    options = databases.scan_options(STORE, "select 1 as a;\n")
    assert options["url"] == "jdbc:postgresql://db:5432/reg" and options["query"] == "select 1 as a"
    assert options["user"] == "u" and options["driver"] == "org.postgresql.Driver" and "dbtable" not in options
    oracle = databases.jdbc_options(STORE | {"type": "oracle"})
    assert oracle["url"] == "jdbc:oracle:thin:@//db:5432/reg"
    assert databases.jdbc_options(STORE | {"type": "sqlserver"})["url"].endswith("databaseName=reg")
    with pytest.raises(ValueError):
        databases.jdbc_options(STORE | {"type": "sftp"})


def test_partitioned_query_scan_options():
    options = databases.scan_options(STORE, "select * from t", Partitioning("id", "0", "1000", 16))
    assert options["dbtable"] == "(select * from t) q" and "query" not in options
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"], options["numPartitions"]) == (
        "id", "0", "1000", "16",
    )


def test_sql_over_views(frame, spark):
    out = databases.scan_sql(spark, "SELECT a.id FROM reg.one a JOIN two b ON a.id = b.id;", {
        "reg.one": frame("id int", (1,), (2,)), "two": frame("id int", (2,), (3,)),
    })
    assert [r["id"] for r in out.collect()] == [2]
    frame("id int", (7,)).createOrReplaceTempView("reg__one_more")
    longer = databases.scan_sql(spark, "SELECT id FROM reg__one_more", {"reg.one": frame("id int", (1,))})
    assert [r["id"] for r in longer.collect()] == [7]


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_is_text_quoted_and_padded(spark, tmp_path):
    path = write(tmp_path / "a.csv", ',Id,json,wkt\n0,007,"{ ""a"": [1, 2] }","POLYGON ((0 0, 1 0, 1 1, 0 0))"\n1,8\n')
    first, second = files.scan_csv(spark, path).collect()
    assert first.asDict() == {"_c0": "0", "Id": "007", "json": '{ "a": [1, 2] }', "wkt": "POLYGON ((0 0, 1 0, 1 1, 0 0))"}
    assert second["Id"] == "8" and second["json"] is None and second["wkt"] is None


def test_configured_scan(spark, tmp_path):
    path = write(tmp_path / "b.csv", "Code;NAAM\n1;café\n", "latin-1")
    df = files.scan_configured(
        spark, path, {"file_type": "CSV", "delimiter": ";", "encoding": "Latin-1", "operators": ["lowercase_keys"]}
    )
    assert df.first().asDict() == {"code": "1", "naam": "café"}
    with pytest.raises(ValueError):
        files.scan_configured(spark, path, {"file_type": "XLS"})
    with pytest.raises(ValueError):
        files.scan_configured(spark, path, {"operators": ["reverse"]})


def test_rows_of_wrong_width_are_found_whatever_is_selected(spark, tmp_path):
    path = write(tmp_path / "c.csv", "a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    df = files.scan_csv(spark, path, columns=["a", "b", "c"], flag_wrong_width=True)
    assert sorted(r["a"] for r in df.where("_corrupt_record is not null").select("a").collect()) == ["4", "6"]


def test_header_only_file_is_an_empty_load(spark, tmp_path):
    df = files.scan_csv(spark, write(tmp_path / "d.csv", "a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0


def test_file_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "rol" / "sub").mkdir(parents=True)
    for name in ("rol/a1.jpg", "rol/sub/b2.jpg", "rol/c3.txt"):
        write(tmp_path / name, "x" * 10)
    df = files.scan_files(spark, str(tmp_path), r"rol/.+\.jpg$")
    assert sorted((r["name"], r["length"]) for r in df.collect()) == [("rol/a1.jpg", 10), ("rol/sub/b2.jpg", 10)]
    assert "content" not in df.columns and "content" not in str(df._jdf.queryExecution().executedPlan())
