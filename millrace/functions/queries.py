"""One query for each family of functions: the sample calls of the catalogue over a whole table, and the same for DuckDB."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.registry import Function, install, known
from millrace.session import table

CALL = re.compile(r"(\w+)\(")
#: The table and key columns that each family's sample calls are written for.
TABLES = {
    "string": ("customer", "c_custkey"),
    "string_ext": ("customer", "c_custkey"),
    "case": ("part", "p_partkey"),
    "number_format": ("part", "p_partkey"),
    "regex": ("part", "p_partkey"),
    "math": ("lineitem", "l_orderkey, l_linenumber AS line"),
    "radix": ("orders", "o_orderkey"),
    "array": ("lineitem", "l_orderkey, l_linenumber AS line"),
    "vector": ("embeddings", "vec_id"),
    "datetime": ("events", "event_id"),
    "conversion": ("orders", "o_orderkey"),
    "json": ("events", "event_id"),
    "text": ("customer", "c_custkey"),
    "identifier": ("customer", "c_custkey"),
    "codec": ("customer", "c_custkey"),
    "url": ("pages", "page_id"),
    "geo": ("supplier", "s_suppkey"),
    "spatial": ("supplier", "s_suppkey"),
}


def sampled() -> dict[str, list[Function]]:
    out = defaultdict(list)
    for f in known().values():
        if f.call and f.oracle:
            out[f.family].append(f)
    return out


def by_kernel(call: str) -> bool:
    """Whether a call comes to a kernel, itself or through the bodies of what it calls."""
    called = [known()[n] for n in CALL.findall(call) if n in known()]
    return any(f.kernel is not None or by_kernel(f.body.replace(f"{f.name}(", "(")) for f in called)


def _query(family: str, functions: list[Function]) -> Callable[[SparkSession, str], DataFrame]:
    name, key = TABLES[family]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        install(spark, dict.fromkeys(n for f in functions for n in CALL.findall(f.call) if n in known()))
        table(spark, sf_dir, name).createOrReplaceTempView(f"_functions_{name}")
        # Rows wait for the kernels' answers with all their columns, so kernels come first, beside the table's own columns.
        made = {f.name for f in functions if by_kernel(f.call)}
        inner = "".join(f", {f.call} AS v_{f.name}" for f in functions if f.name in made)
        outer = ", ".join(f"v_{f.name}" if f.name in made else f"{f.call} AS v_{f.name}" for f in functions)
        return spark.sql(f"SELECT {key}, {outer} FROM (SELECT *{inner} FROM _functions_{name})")

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"fn_{family}": _query(family, fs) for family, fs in sampled().items()}


def oracle_sql() -> dict[str, str]:
    return {f"fn_{family}": f"SELECT {TABLES[family][1]}, {', '.join(f'{f.oracle} AS v_{f.name}' for f in fs)} FROM {TABLES[family][0]}" for family, fs in sampled().items()}
