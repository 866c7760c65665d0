"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 8


def salted_join(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``unique``, which has each key once.

    ``rows`` are spread over ``salts`` parts of each key and ``unique`` is repeated
    once per part, so a hot key goes to several tasks. It also puts a shuffle of its
    own right under the join on both sides: adaptive skew splitting works only
    then, and not where one side comes straight out of an aggregate on the key.
    """
    hashed = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # with the number of the task, so that equal rows of different tasks part too
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *hashed), F.lit(salts)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted = rows.withColumn("_salt", salt)
    return salted.join(unique.withColumn("_salt", parts), [key, "_salt"], how).drop("_salt")
