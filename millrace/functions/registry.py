"""The function catalogue.

Most functions are SQL functions: a line `name(parameters) TYPE = expression` over Spark's built-ins, which Catalyst
inlines, so a call costs what its expression costs and stays in generated code.  What no expression can say is a kernel:
a Python function run over Arrow batches.  A function whose name and meaning are a Spark built-in's is listed as such
(`name = builtin`) and needs no registration; one that shares only the name has its family as a prefix.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LINE = re.compile(r"(\w+)\((.*?)\)\s+([A-Z][A-Za-z<>_:, ()0-9]*?)\s+=\s+(.+)", re.S)


@dataclass(frozen=True)
class Function:
    """One of body (SQL) or kernel; neither for a built-in.  call and oracle: a sample call and DuckDB's equal.

    whole: the kernel takes whole columns as NumPy arrays, not cell by cell.
    """

    name: str
    family: str
    parameters: str = ""
    returns: str = ""
    body: str = ""
    kernel: Callable | None = None
    call: str = ""
    oracle: str = ""
    whole: bool = False


def parse(family: str, lines: str) -> list[Function]:
    """Functions of a family, one a line: definition [;; sample call [;; the same for DuckDB]].  # starts a comment."""
    out = []
    for line in lines.strip().splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        definition, call, oracle = ([x.strip() for x in line.split(";;")] + ["", ""])[:3]
        if m := re.fullmatch(r"(\w+) = builtin", definition):
            out.append(Function(m[1], family, call=call, oracle=oracle))
        elif m := LINE.fullmatch(definition):
            out.append(Function(m[1], family, m[2], m[3], m[4], call=call, oracle=oracle))
        else:
            raise ValueError(f"{family}: not a definition: {definition}")
    return out


def kernel(family: str, name: str, returns: str, f: Callable, nulls: bool = False) -> Function:
    """A Python function over rows of Arrow batches.  A null argument gives null unless `nulls`."""
    return Function(name, family, returns=returns, kernel=_null_safe(f) if not nulls else f)


def columns(family: str, name: str, returns: str, f: Callable, call: str = "", oracle: str = "") -> Function:
    """A NumPy function of whole columns of numbers.  A null argument gives null."""
    return Function(name, family, returns=returns, kernel=f, call=call, oracle=oracle, whole=True)


def _null_safe(f: Callable) -> Callable:
    def run(*args):
        return None if any(a is None for a in args) else f(*args)

    return run


def _plain(x):
    """A cell for a kernel: None for what is missing, a float for a decimal."""
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    return float(x) if isinstance(x, Decimal) else x


def trim() -> None:
    """Give back to the system what earlier batches have freed, so a worker does not grow with the rows it has seen."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def _vectorised(f: Function):
    whole = f.returns.lower() in ("long", "int", "bigint")

    if f.whole:
        kind = np.int64 if whole else np.float64

        @F.pandas_udf(f.returns)
        def run_whole(*columns: pd.Series) -> pd.Series:
            null = np.logical_or.reduce([c.isna().to_numpy() for c in columns])
            got = f.kernel(*(c.fillna(1).to_numpy().astype(kind) for c in columns))
            return pd.Series(got, dtype="Int64" if whole else "Float64").mask(null)

        return run_whole

    @F.pandas_udf(f.returns)
    def run(*columns: pd.Series) -> pd.Series:
        trim()
        rows = zip(*([_plain(x) for x in c] if c.dtype.kind in "fO" else c.tolist() for c in columns), strict=True)
        got = [f.kernel(*r) for r in rows]
        return pd.Series(got, dtype="Int64") if whole else pd.Series(got, dtype=object)

    return run


def catalogue() -> dict[str, Function]:
    """All functions by name."""
    from millrace.functions import aliases, arrays, codecs, conversion, datetime, formats, geo, identifiers, json_text, mathematics, more, network, phonetics, sketches, spatial, strings, text

    found: dict[str, Function] = {}
    for module in (strings, mathematics, arrays, datetime, conversion, json_text, text, identifiers, codecs, network, geo, formats, sketches, phonetics, spatial, aliases, more):
        for f in module.FUNCTIONS:
            if f.name in found:
                raise ValueError(f"two functions named {f.name}")
            found[f.name] = f
    return found


_CATALOGUE: dict[str, Function] = {}


def known() -> dict[str, Function]:
    if not _CATALOGUE:
        _CATALOGUE.update(catalogue())
    return _CATALOGUE


def install(spark: SparkSession, names: Iterable[str] | None = None) -> list[str]:
    """Register functions (default: all), with what their bodies call, as temporary functions of the session."""
    table, done = known(), []

    def one(name: str) -> None:
        f = table[name]
        if name in done:
            return
        done.append(name)
        if f.kernel is not None:
            spark.udf.register(name, _vectorised(f))
        elif f.body:
            for used in set(re.findall(r"(\w+)\(", f.body)) & table.keys() - {name}:
                one(used)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({f.parameters}) RETURNS {f.returns} RETURN {f.body}")

    for name in table if names is None else names:
        one(name)
    return done


def sql(spark: SparkSession, text: str):
    """spark.sql with the catalogue's functions that the text calls."""
    install(spark, [n for n in dict.fromkeys(re.findall(r"(\w+)\s*\(", text)) if n in known()])
    return spark.sql(text)
