"""Scans: views, delimited files, file listings, header rules.

The file queries write the given table to the shared folder first and read it
back with the scan under test.
"""

from pyspark.sql import functions as F

from checks.registry import check
from stateweave.operators import projection
from stateweave.session import shared_path
from stateweave.sources import databases, files


@check(
    "s2_view_scan",
    "SELECT s_suppkey, upper(s_name) AS name, s_acctbal FROM supplier WHERE s_acctbal > 0",
)
def _(t):
    sql = "SELECT s_suppkey, upper(s_name) AS name, s_acctbal FROM trade.supplier WHERE s_acctbal > 0;"
    return databases.scan_sql(t.spark, sql, {"trade.supplier": t.supplier})


@check(
    "s4_delimited_file_scan",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ' é;ü' AS c_name, c_mktsegment FROM customer",
)
def _(t):
    path = shared_path(t.spark, "csv")
    rows = t.customer.select("c_custkey", F.concat("c_name", F.lit(" é;ü")).alias("c_name"), "c_mktsegment")
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return files.scan_configured(t.spark, path, {"file_type": "CSV", "delimiter": ";", "encoding": "Latin-1"})


@check(
    "s5_all_text_csv_scan",
    """SELECT CAST(event_id AS VARCHAR) AS unnamed, event_type,
              '{"a": "x, y", "p": ' || props || '}' AS props FROM events""",
)
def _(t):
    path = shared_path(t.spark, "csv")
    props = F.concat(F.lit('{"a": "x, y", "p": '), "props", F.lit("}"))
    rows = t.events.select(F.col("event_id").alias(" "), "event_type", props.alias("props"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return files.scan_csv(t.spark, path).withColumnRenamed("_c0", "unnamed")


@check(
    "s6_ragged_row_scan",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name,
              CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM customer""",
)
def _(t):
    path = shared_path(t.spark, "csv")
    short = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name")
    full = F.concat_ws(",", short, "c_mktsegment")
    t.customer.select(F.when(F.col("c_custkey") % 7 == 0, short).otherwise(full).alias("line")).write.text(path)
    return files.scan_csv(t.spark, path, columns=["key", "name", "segment"], header=False)


@check(
    "s8_file_listing",
    "SELECT lang, source, count(*) AS rows, true AS sized, CAST(1 AS BIGINT) AS files FROM documents GROUP BY lang, source",
)
def _(t):
    """Every file by name, held against the rows that reading it gives; one file a folder."""
    path = shared_path(t.spark, "files")
    t.documents.select("doc_id", "lang", "source").repartition("lang", "source").write.partitionBy("lang", "source").parquet(path)
    listed = files.scan_files(t.spark, path, r".+\.parquet$")
    part = lambda key: F.regexp_extract("name", rf"{key}=([^/]+)/", 1).alias(key)
    read = t.spark.read.parquet(path).groupBy(F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+/[^/]+)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    named = listed.select(F.regexp_extract("name", r"([^/]+/[^/]+/[^/]+)$", 1).alias("file"), part("lang"), part("source"), (F.col("length") > 0).alias("sized"))
    both = named.join(read, "file", "left").groupBy("lang", "source")
    return both.agg(F.sum("rows").alias("rows"), F.min("sized").alias("sized"), F.count(F.lit(1)).alias("files"))


@check(
    "s9_file_filter",
    r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://.+\.html$')",
)
def _(t):
    return files.filter_files(t.pages.select("page_id", "url"), r"https://.+\.html$", column="url")


@check("s10_lowercase_keys", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    upper = t.nation.toDF(*[c.upper() for c in t.nation.columns])
    return projection.lowercase_keys(upper)


@check(
    "s11_rename_identifiers",
    "SELECT p_partkey AS part_key, p_name AS part_name, p_size AS part_size FROM part",
)
def _(t):
    quoted = t.part.selectExpr("p_partkey AS `partKey`", "p_name AS `Part Name`", "p_size AS `partSize`")
    return projection.rename(quoted, {"partKey": "part_key", "Part Name": "part_name", "partSize": "part_size"})
