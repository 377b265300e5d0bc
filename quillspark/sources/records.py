"""Files of records: JSON lines and CSV with a contract, accepted and quarantined rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_lines_tagged(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and malformed lines with a reason."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__none"})).withColumn("whole", F.try_parse_json("value"))
    kind = F.schema_of_variant("whole")
    reason = F.when(F.col("whole").isNull(), "INVALID_JSON").when(~kind.startswith("OBJECT"), "INVALID_JSON_ROOT")
    tagged = parsed.withColumn("reason", reason)
    return tagged.where("reason is null").select("row.*"), tagged.where("reason is not null").select("value", "reason")


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """Canonical lines in one total order over the part files."""
    df.select(canonical_json(df).alias("value"), *(F.col(c).alias(f"__{c}") for c in order)).repartitionByRange(*(f"__{c}" for c in order)).sortWithinPartitions(*(f"__{c}" for c in order)).select("value").write.text(path)


def lines_digest(df: DataFrame, key: str) -> DataFrame:
    """``key, records, digest`` per key: an order-free digest (sum of line hashes) that many tasks can share.

    The sum is taken modulo 2^64, as a signed number: of some 65,000 lines on a key it can pass what 64 bits hold.
    """
    h = F.conv(F.substring(F.sha2(canonical_json(df).cast("binary"), 256), 1, 12), 16, 10).cast("long")
    halves = F.sum(F.shiftright("h", 24)).alias("__high"), F.sum(F.col("h").bitwiseAND((1 << 24) - 1)).alias("__low")
    # Whole 2^40 of the upper halves are multiples of 2^64 and go; what is left is added exactly.
    exact = F.col("__high").bitwiseAND((1 << 40) - 1).cast("decimal(20,0)") * F.lit(1 << 24).cast("decimal(10,0)") + F.col("__low").cast("decimal(20,0)")
    whole = F.lit(str(1 << 64)).cast("decimal(20,0)")
    rest = exact % whole
    digest = F.when(rest >= F.lit(str(1 << 63)).cast("decimal(20,0)"), rest - whole).otherwise(rest).cast("long")
    return df.select(F.col(key), h.alias("h")).groupBy(key).agg(F.count("*").alias("records"), *halves).select(key, "records", digest.alias("digest"))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text under the given header; quotes doubled, cells may hold line ends; another header fails."""
    raw = spark.read.options(header=True, multiLine=True, escape='"', enforceSchema=False).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return raw


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, escape='"').csv(path)


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with ``reasons``: the names of all checks that fail, in order."""
    reasons = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())
    tagged = df.withColumn("reasons", reasons)
    return tagged.where(F.size("reasons") == 0).drop("reasons"), tagged.where(F.size("reasons") > 0)


def parse_box_line(line: Column) -> Column:
    """``x1,y1,...,x4,y4,text`` where the text may hold commas: numbers, text, and an error code."""
    parts = F.split(line, ",", 9)
    numbers = F.transform(F.slice(parts, 1, 8), lambda x: F.trim(x).try_cast("double"))
    bad = (F.size(parts) < 9) | F.exists(numbers, lambda x: x.isNull())
    return F.struct(F.when(~bad, numbers).alias("numbers"), F.when(~bad, parts[8]).alias("text"), F.when(bad, "BAD_BOX_LINE").alias("error"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
