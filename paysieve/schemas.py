"""Table schemas. A payment request is one flat row; lists of findings are arrays of ``CHECK``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
          "boolean": T.BooleanType(), "map<string_string>": T.MapType(T.StringType(), T.StringType()),
          "array<string>": T.ArrayType(T.StringType())}


def struct_of(ddl: str) -> T.StructType:
    """A schema from ``name type, ...`` that can be built before any session exists."""
    fields = [f.split() for f in ddl.replace("map<string,string>", "map<string_string>").split(",")]
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in fields])


PAYMENTS = struct_of("""
  seq bigint, scan_id string, ms bigint, direction string, account_hash string, agent_id string,
  scheme string, network string, asset string, amount string, amount_usd double, asset_decimals double,
  pay_to string, payer string, resource_url string, description string, reason string, nonce string,
  valid_until string, metadata map<string,string>, expected_price_usd double,
  origin string, content string, content_source_url string, phase string, offer string,
  force_deep boolean, skip_deep boolean""")

CHECK = ("struct<ord:int,id:string,verdict:string,severity:string,"
         "details:map<string,string>,implicated_address:string>")
CHECKS = f"array<{CHECK}>"


def conform(df: DataFrame, schema: T.StructType = PAYMENTS) -> DataFrame:
    """Give ``df`` every column of the schema (typed nulls where absent), keeping extra columns."""
    have = set(df.columns)
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in schema.fields], *extra)
