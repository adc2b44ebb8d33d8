"""Attribute–value rows into wide, typed tables.

Values are normalised and collapsed to one row per cell inside the JVM, with
partial aggregation, so that no entity, however often repeated, reaches a task
with more rows than there are attributes. Entities are then hash-bucketed; in a
bucket entity and attribute are dictionary-encoded and values scattered into
one numpy array per type by row and column index, which become Arrow columns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normgraph.staging import buckets_for

_SPARK = {"text": T.StringType(), "int": T.LongType(), "decimal": T.DecimalType(38, 10), "date": T.DateType(), "boolean": T.BooleanType()}
_ARROW = {"text": pa.string(), "int": pa.int64(), "decimal": pa.decimal128(38, 10), "date": pa.date32(), "boolean": pa.bool_()}


def _digits(s):
    """Sign and digits in one form: no plus, no leading zeros, no minus zero."""
    s = F.regexp_replace(F.regexp_replace(s, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(s == "-0", "0").otherwise(s)


def _fraction(s):
    s = F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    return _digits(s)


def canonical(value, value_type):
    """Comparable text of a trimmed value, null where it does not convert to its type."""
    low = F.lower(value)
    day = F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[\s\S]*)?\z") & ~value.startswith("0000"), F.substring(value, 1, 10))
    return (
        F.when(value_type == "int", F.when(value.rlike(r"^[+-]?[0-9]+\z"), _digits(value)))
        .when(value_type == "decimal", F.when(value.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?\z"), _fraction(value)))
        .when(value_type == "date", F.when(day.try_cast("date").isNotNull(), day))
        .when(value_type == "boolean", F.when(low.isin("true", "yes", "1"), "true").when(low.isin("false", "no", "0"), "false"))
        .otherwise(value)
    )


def column_names(predicates: list[str]) -> list[str]:
    """Column per predicate; clashing names get a number."""
    out: list[str] = []
    for p in predicates:
        base = re.sub(r"\W+", "_", p).strip("_").lower() or "value"
        name, k = base, 2
        while name in (*out, "subject", "invalid"):
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def _wide(names: list[str], preds: list[str], kinds: list[str]):
    def run(t: pa.Table) -> pa.Table:
        """Cells of one bucket of entities to one row per entity."""
        entity = t["subject"].combine_chunks().dictionary_encode()
        row, col, ok = np.asarray(entity.indices), np.asarray(t["attr"]), np.asarray(t["ok"])
        n = len(entity.dictionary)
        # number: int, days, 0/1; decimals and texts are scattered as places in their column
        number, known = np.asarray(t["number"].fill_null(0)), np.asarray(t["number"].is_valid())
        place = np.arange(len(row))
        out = [entity.dictionary]
        for k, kind in enumerate(kinds):
            at = np.flatnonzero((col == k) & ok & (known | (kind in ("text", "decimal"))))
            empty = np.ones(n, dtype=bool)
            empty[row[at]] = False
            if kind in ("text", "decimal"):
                places = np.zeros(n, dtype=np.int64)
                places[row[at]] = place[at]
                out.append(t["text" if kind == "text" else "decimal"].combine_chunks().take(pa.array(places, mask=empty)))
            else:
                values = np.zeros(n, dtype={"int": np.int64, "date": np.int32, "boolean": bool}[kind])
                values[row[at]] = number[at]
                out.append(pa.array(values, mask=empty).cast(_ARROW[kind]))
        wrong = np.flatnonzero(~ok)
        wrong = wrong[np.lexsort((col[wrong], row[wrong]))]
        ends = np.searchsorted(row[wrong], np.arange(n + 1)).astype(np.int32)
        invalid = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.asarray(preds, dtype=object)[col[wrong]], pa.string()))
        return pa.table([*out, invalid], names=["subject", *names, "invalid"])

    return run


def wide_table(triples: DataFrame, attributes: DataFrame, rows_per_bucket: int = 400_000) -> DataFrame:
    """One row per subject with a typed column per single-valued attribute.

    triples: (subject, predicate, object); attributes: (predicate, full_uri,
    value_type, cardinality). Only these columns are read. A predicate counts in
    either notation. Values are trimmed of blanks and tabs; null and blank ones
    do not count. ``invalid`` lists the attributes of which some value does not
    convert or which have more than one value; their columns are null. Values
    beyond bigint, or beyond 28 digits before and 10 after the point, are valid
    but null in the column. Rows with a null subject or predicate are ignored;
    a subject without any counted value of a listed attribute still gets a row,
    of nulls. Empty triples give no rows; no attributes gives subjects only.

    The attribute table is the schema of the result; it is read to the driver.
    """
    listed = attributes.filter("cardinality = 'one' and predicate is not null").groupBy("predicate").agg(F.min("full_uri").alias("full_uri"), F.min("value_type").alias("value_type")).orderBy("predicate").collect()
    preds, kinds = [r.predicate for r in listed], [r.value_type if r.value_type in _SPARK else "text" for r in listed]
    names = column_names(preds)
    spark = triples.sparkSession
    both = [(notation, k, kinds[k]) for k, r in enumerate(listed) for notation in dict.fromkeys((r.predicate, r.full_uri)) if notation]
    known = spark.createDataFrame(both, "predicate string, attr int, kind string")

    t = triples.select("subject", "predicate", F.trim(F.regexp_replace("object", r"^[ \t]+|[ \t]+$", "")).alias("value"))
    t = t.filter("subject is not null and predicate is not null").join(F.broadcast(known), "predicate", "left")
    value = F.when(F.col("attr").isNotNull() & (F.col("value") != ""), F.col("value"))
    t = t.select("subject", F.coalesce("attr", F.lit(-1)).alias("attr"), "kind", value.alias("value"))
    t = t.withColumn("c", canonical(F.col("value"), F.col("kind")))
    cells = t.groupBy("subject", "attr").agg(F.max("kind").alias("kind"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.col("value").isNotNull() & F.col("c").isNull()).alias("bad"), F.count("value").alias("n"))
    ok = F.coalesce(~F.col("bad") & (F.col("lo") == F.col("hi")), F.lit(False)) | (F.col("n") == 0)
    kind, lo = F.col("kind"), F.col("lo")
    number = F.when(kind == "int", lo.try_cast("bigint")).when(kind == "date", F.datediff(lo.try_cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")).when(kind == "boolean", (lo == "true").cast("bigint"))
    exact = F.when(kind == "decimal", F.when(~lo.rlike(r"\.[0-9]{11}"), lo.try_cast("decimal(38,10)")))
    cells = cells.select("subject", "attr", ok.alias("ok"), number.alias("number"), exact.alias("decimal"), F.when(kind == "text", lo).alias("text"))
    bucket = F.pmod(F.xxhash64("subject"), F.lit(buckets_for(triples.count(), rows_per_bucket, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    schema = T.StructType([T.StructField("subject", T.StringType()), *(T.StructField(c, _SPARK[k]) for c, k in zip(names, kinds)), T.StructField("invalid", T.ArrayType(T.StringType()))])
    run = _wide(names, preds, kinds)
    return cells.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(lambda x: run(x), schema)


def _table(spark: SparkSession, d: str) -> DataFrame:
    return wide_table(spark.read.parquet(f"{d}/triples.parquet"), spark.read.parquet(f"{d}/attributes.parquet"))


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).drop("invalid")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).select("subject", F.explode("invalid").alias("predicate"))
