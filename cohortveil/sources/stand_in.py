"""A stand-in cohort over the star-schema tables, whose rows are numbers and names of no patient.

Line items are images: a supplier is a patient and a return flag with a line
status is a series.  Orders are objects with full headers: a customer is a
patient.  The texts here are data, worked out by arithmetic that any SQL
engine does alike, and hold no operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Images, one a line item.  {lineitem} and {supplier} are tables.
IMAGES = """
SELECT t.*, '1.2.3.40.' || CAST(pid AS STRING) || '.' || CAST(series_number AS STRING) AS series_uid,
  'P' || CAST(pid AS STRING) AS patient, 'P' || CAST(pid AS STRING) AS patient_id, s_name AS patient_name,
  CASE pid % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '' END AS sex, CAST(1940 + pid % 50 AS STRING) || '0' || CAST(1 + pid % 9 AS STRING) || '1' || CAST(pid % 10 AS STRING) AS birth_date, CASE series_number WHEN 1 THEN 'Maker A M1' ELSE 'Maker B M2' END AS scanner,
  'P' || CAST(pid AS STRING) || '/S' || CAST(series_number AS STRING) || '/' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) AS path,
  CASE (pid + series_number) % 11 WHEN 0 THEN 'SR' WHEN 1 THEN 'US' WHEN 2 THEN 'DX' ELSE 'CT' END AS modality,
  CASE (pid + series_number) % 11 WHEN 0 THEN '1.2.840.10008.5.1.4.1.1.88.67' WHEN 1 THEN '1.2.840.10008.5.1.4.1.1.6.1' WHEN 2 THEN '1.2.840.10008.5.1.4.1.1.1.1' ELSE '1.2.840.10008.5.1.4.1.1.2' END AS sop_class_uid,
  CASE (pid * 5 + series_number * 7) % 6 WHEN 0 THEN 0.5E0 WHEN 1 THEN 0.6E0 WHEN 2 THEN 0.75E0 WHEN 3 THEN 0.75E0 WHEN 4 THEN 1.0E0 ELSE 3.0E0 END AS slice_mm,
  CASE (pid * 3 + series_number) % 5 WHEN 0 THEN 350.0E0 ELSE 200.0E0 END AS fov_mm,
  CASE (pid + 2 * series_number) % 4 WHEN 0 THEN 'K21' WHEN 1 THEN 'Kv33' WHEN 2 THEN 'B80s' ELSE 'FB12' END AS kernel,
  CASE (pid + series_number) % 3 WHEN 0 THEN '' ELSE 'Iodine agent' END AS contrast,
  CASE (pid * 2 + series_number * 3) % 7 WHEN 0 THEN 'Heart CTA thin 70%' WHEN 1 THEN 'Calcium plain' WHEN 2 THEN 'Gated snap shot burst' WHEN 3 THEN 'Acquisition 9' WHEN 4 THEN 'Oblique mpr view' WHEN 5 THEN 'Coro angio fine' ELSE 'Scout lateral' END AS description,
  CASE WHEN (pid + series_number) % 13 = 0 THEN 'DERIVED\\SECONDARY\\AXIAL' WHEN (pid * 2 + series_number * 3) % 7 = 6 THEN 'ORIGINAL\\PRIMARY\\LOCALIZER' ELSE 'ORIGINAL\\PRIMARY\\AXIAL' END AS image_type,
  CASE WHEN (pid * 7 + series_number) % 10 = 0 THEN 'YES' ELSE 'NO' END AS burned_in,
  CASE WHEN (pid + series_number) % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE 75.0E0 END AS phase, 0 AS frames,
  CASE WHEN l_linenumber = 3 THEN '' ELSE CAST(l_linenumber + 10 * (l_orderkey % 1000) AS STRING) END AS instance_number,
  CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS STRING) AS study_date
FROM (SELECT l_suppkey AS pid, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 5 END + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS series_number,
        l_orderkey, l_linenumber, l_partkey, l_shipdate FROM {lineitem}) t JOIN {supplier} s ON t.pid = s.s_suppkey
"""

#: Header attributes of an order's object: group, path, keyword, vr, private and the value's SQL.
ATTRIBUTES = [
    ("data", "PatientName", "PN", 0, "c_mktsegment || '^' || 'A' || CAST(o_custkey AS STRING)"),
    ("data", "PatientID", "LO", 0, "'H' || CAST(1000000 + o_custkey AS STRING)"),
    ("data", "PatientBirthDate", "DA", 0, "CAST((1930 + o_custkey % 70) * 10000 + (1 + o_custkey % 12) * 100 + 1 + o_custkey % 28 AS STRING)"),
    ("data", "PatientSex", "CS", 0, "CASE o_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'O' END"),
    ("data", "PatientAge", "AS", 0, "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '030M' ELSE '058Y' END"),
    ("data", "PatientWeight", "DS", 0, "CAST(50 + o_custkey % 50 AS STRING)"),
    ("data", "StudyDate", "DA", 0, "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS STRING)"),
    ("data", "ContentDate", "DA", 0, "''"),
    ("data", "StudyTime", "TM", 0, "'083005.25'"),
    ("data", "AcquisitionDateTime", "DT", 0, "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS STRING) || '091500.5'"),
    ("data", "AccessionNumber", "SH", 0, "'ACC' || CAST(o_orderkey AS STRING)"),
    ("data", "Manufacturer", "LO", 0, "CASE o_orderkey % 2 WHEN 0 THEN 'Maker A' ELSE 'Maker B' END"),
    ("data", "ManufacturerModelName", "LO", 0, "'Model ' || CAST(o_orderkey % 5 AS STRING)"),
    ("data", "InstitutionName", "LO", 0, "'Hospital ' || CAST(c_nationkey AS STRING)"),
    ("data", "InstitutionAddress", "ST", 0, "'7 Mill Lane'"),
    ("data", "ReferringPhysicianName", "PN", 0, "'WREN^T'"),
    ("data", "StudyDescription", "LO", 0, "o_orderpriority"),
    ("data", "SeriesDescription", "LO", 0, "'Order ' || o_orderpriority"),
    ("data", "ImageComments", "LT", 0, "'scan of ' || c_mktsegment || ' seen ' || CAST(year(o_orderdate) AS STRING)"),
    ("data", "BodyPartExamined", "CS", 0, "CASE o_custkey % 5 WHEN 0 THEN c_mktsegment ELSE 'HEART' END"),
    ("data", "StudyInstanceUID", "UI", 0, "'1.2.3.41.' || CAST(o_custkey AS STRING)"),
    ("data", "SOPInstanceUID", "UI", 0, "'1.2.3.41.' || CAST(o_custkey AS STRING) || '.' || CAST(o_orderkey AS STRING)"),
    ("data", "SOPClassUID", "UI", 0, "'1.2.840.10008.5.1.4.1.1.2'"),
    ("data", "FrameOfReferenceUID", "UI", 0, "'1.2.3.42.' || CAST(o_custkey AS STRING) || '\\1.2.840.10008.1.4.1.1'"),
    ("data", "SynchronizationFrameOfReferenceUID", "UI", 0, "''"),
    ("data", "ImageType", "CS", 0, "'ORIGINAL\\PRIMARY\\AXIAL\\VARIANT9'"),
    ("data", "ConvolutionKernel", "SH", 0, "'K21'"),
    ("data", "PregnancyStatus", "US", 0, "'4'"),
    ("data", "PerformedProtocolCodeSequence", "SQ", 0, "'1'"),
    ("data", "PerformedProtocolCodeSequence[0].CodeValue", "SH", 0, "'HEARTP'"),
    ("data", "RequestAttributesSequence", "SQ", 0, "'1'"),
    ("data", "RequestAttributesSequence[0].ScheduledProcedureStepID", "SH", 0, "'R' || CAST(o_orderkey AS STRING)"),
    ("data", "ReferencedImageSequence", "SQ", 0, "'1'"),
    ("data", "ReferencedImageSequence[0].ReferencedSOPInstanceUID", "UI", 0, "'1.2.3.43.' || CAST(o_orderkey AS STRING)"),
    ("data", "ReferencedImageSequence[0].ReferencedSOPClassUID", "UI", 0, "'1.2.840.10008.5.1.4.1.1.2'"),
    ("data", "ReferencedImageSequence[0].AcquisitionDate", "DA", 0, "'20170808'"),
    ("data", "(0051,1001)", "UN", 1, "'16'"),
    ("data", "ReferencedImageSequence[0].(0b05,1002)", "UN", 1, "'12'"),
    ("meta", "MediaStorageSOPInstanceUID", "UI", 0, "'1.2.3.41.' || CAST(o_custkey AS STRING) || '.' || CAST(o_orderkey AS STRING)"),
    ("meta", "SendingApplicationEntityTitle", "AE", 0, "'ARCHIVE7'"),
]

#: Objects, one an order, with their patient.
OBJECTS = "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_totalprice, o_orderstatus, c_mktsegment, c_nationkey, c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"


def elements_sql() -> str:
    """One row an attribute of each object, in one text for any engine: grp, path, vr, private and value."""
    listed = ", ".join(f"('{g}', '{p}', '{vr}', {private})" for g, p, vr, private, _ in ATTRIBUTES)
    value = " ".join(f"WHEN '{p}' THEN {sql}" for _, p, _, _, sql in ATTRIBUTES)
    return f"SELECT o_orderkey AS instance_id, o_custkey, 'H' || CAST(1000000 + o_custkey AS STRING) AS patient_id, grp, path, vr, private = 1 AS is_private, CASE path {value} END AS value FROM ({OBJECTS}) b CROSS JOIN (VALUES {listed}) a(grp, path, vr, private)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str | Column, most: int = 50_000, rows: DataFrame | None = None) -> DataFrame:
    """Rows dealt out to all cores, to as many partitions as shuffles have, and to more where these would get over `most` rows.

    The tables come as one row group each, and what is made of a row here is long work: a task's must not grow with the table.
    `rows` has as many rows as df, where these are counted with less work.
    """
    spark, count = df.sparkSession, (df if rows is None else rows).count()
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // most)), *key)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, a patient's in 16 partitions at most, so that partial aggregates by series or study leave few rows to shuffle."""
    text = IMAGES.replace("\\", "\\\\")
    return spark.sql(text, lineitem=spread(table(spark, sf_dir, "lineitem"), "l_suppkey", F.pmod(F.hash("l_orderkey"), F.lit(16))), supplier=table(spark, sf_dir, "supplier"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects dealt out by their key after they met their patients, so that what is made of an object stays together.

    Before it, a join that isn't a broadcast one would deal them anew, and all their elements were shuffled wherever they are grouped.
    """
    orders = table(spark, sf_dir, "orders")
    return spread(spark.sql(OBJECTS, orders=orders, customer=table(spark, sf_dir, "customer")), "o_orderkey", rows=orders)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header elements of all objects; attributes are exploded from a literal list, so nothing is shuffled for them."""
    listed = F.array(*(F.struct(F.lit(g).alias("grp"), F.lit(p).alias("path"), F.lit(vr).alias("vr"), F.lit(private == 1).alias("is_private"), F.expr(sql.replace("\\", "\\\\")).alias("value")) for g, p, vr, private, sql in ATTRIBUTES))
    rows = objects(spark, sf_dir).select(F.col("o_orderkey").alias("instance_id"), "o_custkey", F.expr("'H' || CAST(1000000 + o_custkey AS STRING)").alias("patient_id"), F.explode(listed).alias("e"))
    return rows.select("instance_id", "o_custkey", "patient_id", "e.*")
