"""Code lists kept as one file folder per sheet (S6): read together, told apart by the name of the file's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.operators.joins import checked_join

SHEET_SCHEMA = "code string, libelle string, status string, hierarchie string"


def write_sheets(codes: DataFrame, root: str) -> None:
    """codes (sheet, and the columns of SHEET_SCHEMA) as CSV, a folder ``sheet=<name>`` for each sheet."""
    cols = [c.split()[0] for c in SHEET_SCHEMA.split(", ")]
    codes.select("sheet", *cols).write.partitionBy("sheet").option("header", True).csv(root)


def read_sheets(spark: SparkSession, root: str, owners: dict[str, list[str]]) -> DataFrame:
    """The code dimension (code, libelle, status, comorb, hierarchie) of all sheets.  A comorbidity may own several sheets;
    a sheet has one owner (or the read fails); sheets without an owner and rows without a code are left out."""
    files = spark.read.schema(SHEET_SCHEMA).option("header", True).option("recursiveFileLookup", "true").csv(root)
    sheet = F.regexp_extract(F.col("_metadata.file_path"), r"sheet=([^/]+)/", 1)
    rows = files.select("*", sheet.alias("sheet")).na.drop(subset=["code"])
    mine = spark.createDataFrame([(s, c) for c, own in owners.items() for s in own], "sheet string, comorb string")
    out = checked_join(rows, mine, ["sheet"], "inner", "m:1", small=True, what="owners")
    return out.select("code", "libelle", "status", "comorb", "hierarchie")
