"""Table-valued functions: series, unnesting, prefixes, JSON trees, gap-fill series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """value: start to stop inclusive.  A step of 0 is an error; a negative one walks down.  Rows are made in parallel."""
    if not step:
        raise ValueError("generate_series: step is 0")
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "value")


def unnest(df: DataFrame, column: str) -> DataFrame:
    """df's rows with (idx, value) of an array."""
    return df.select("*", F.posexplode(column).alias("idx", "value"))


def json_each(df: DataFrame, column: str, path: str = "$") -> DataFrame:
    """df's rows with (idx, key, value) of the members of a JSON object or array; value is JSON text."""
    kept = ", ".join(f"_t.`{c}`" for c in df.columns)
    return df.sparkSession.sql(f"SELECT {kept}, e.pos AS idx, e.key, to_json(e.value) AS value FROM {{t}} AS _t, LATERAL variant_explode(variant_get(parse_json(_t.`{column}`), '{path}', 'variant')) AS e", t=df)


def prefixes(df: DataFrame, column: str) -> DataFrame:
    """df's rows with each prefix of a text, from one character on."""
    made = F.transform(F.sequence(F.lit(1), F.length(column)), lambda i: F.substring(F.col(column), F.lit(1), i))
    return df.where(F.length(column) > 0).select("*", F.explode(made).alias("prefix"))


def gap_fill_series(spark: SparkSession, start: str, end: str, interval: str) -> DataFrame:
    """bucket: from the bucket of start up to end, end exclusive."""
    span = spark.sql(f"SELECT explode(sequence(window(timestamp(:a), '{interval}').start, timestamp(:b), INTERVAL {interval})) AS bucket", args={"a": start, "b": end})
    return span.where(F.col("bucket") < F.lit(end).cast("timestamp"))


def json_tree(df: DataFrame, column: str) -> DataFrame:
    """df's rows with (path, type, atom) of every node of a JSON text, the root first."""
    import json

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("path", T.StringType()), T.StructField("type", T.StringType()), T.StructField("atom", T.StringType())])
    names = {bool: "boolean", dict: "object", list: "array", str: "text", int: "integer", float: "real", type(None): "null"}

    def walk(node, path):
        yield path, names[type(node)], None if isinstance(node, dict | list) else json.dumps(node)
        for k, v in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
            yield from walk(v, f"{path}.{k}" if isinstance(node, dict) else f"{path}[{k}]")

    def run(batches):
        for pdf in batches:
            at = [(i, *r) for i, t in enumerate(pdf[column]) if t is not None for r in walk(json.loads(t), "$")]
            out = pdf.iloc[[r[0] for r in at]].reset_index(drop=True)
            for k, name in enumerate(("path", "type", "atom")):
                out[name] = [r[k + 1] for r in at]
            yield out

    return df.mapInPandas(run, schema)
