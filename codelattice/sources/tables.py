"""Schemas, readers and writers of nodes, edges and type tokens, and their projections from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, kind string, name string, meta struct<file: string, lineno: int, end_lineno: int, typing: array<string>, bases: array<string>, args: int>"
EDGE = "src string, dst string, rel string, weight double"
TYPE = "symbol string, type_token string, count int"

#: SQL that Spark and DuckDB read alike; tables stand in braces.
NODES_SQL = """SELECT concat('part_', lpad(cast(p_partkey AS string), 6, '0')) AS id, lower(p_type) AS kind, p_name AS name,
  concat('catalog/', replace(p_brand, '#', '_'), '/', lower(p_type), '.py') AS file, p_size AS lineno,
  p_size + cast(p_partkey % 7 AS int) AS end_lineno, cast(p_partkey AS bigint) AS ord FROM {part}"""
_PART = "concat('part_', lpad(cast({0}.l_partkey AS string), 6, '0'))"
_NEXT = "FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
EDGES_SQL = f"""SELECT {_PART.format('a')} AS src, {_PART.format('b')} AS dst, 'calls' AS rel, max(cast(round(1.0 - a.l_discount, 2) AS double)) AS weight
{_NEXT} WHERE a.l_returnflag = 'R' AND a.l_quantity >= 40 AND b.l_quantity >= 25 AND a.l_partkey <> b.l_partkey GROUP BY 1, 2
UNION ALL SELECT {_PART.format('a')} AS src, concat(CASE WHEN b.l_partkey % 50 = 0 THEN 'missing_' ELSE '' END, {_PART.format('b')}) AS dst, 'cooccurs' AS rel,
  max(cast(CASE WHEN b.l_quantity >= 25 THEN 0.5 ELSE 0.3 END AS double)) AS weight
{_NEXT} WHERE a.l_returnflag = 'A' AND a.l_quantity >= 45 AND a.l_partkey <> b.l_partkey GROUP BY 1, 2"""
TYPES_SQL = """SELECT concat('part_', lpad(cast(p_partkey AS string), 6, '0')) AS symbol,
  CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN concat('List[', lower(p_type), ']') ELSE concat('Dict[str, ', lower(p_type), ']') END AS type_token,
  1 + p_size % 5 AS count FROM {part}"""


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projected(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("part", "lineitem") if f"{{{n}}}" in sql]
    return spark.sql(sql, **{n: parquet(spark, sf_dir, n) for n in names})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, NODES_SQL)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, EDGES_SQL)


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, TYPES_SQL)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a fixed schema; blank lines are left out, bad ones go to _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def with_defaults(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.coalesce("rel", F.lit("unknown")).alias("rel"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def write_model(path: str, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Each table under its own folder; what was written is read back and counted."""
    counts = {}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = table.sparkSession.read.parquet(f"{path}/{name}").count()
    return counts


def read_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
