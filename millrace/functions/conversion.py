"""Conversions that give NULL where a value does not fit, and exact decimals."""

from __future__ import annotations

from decimal import Context, Decimal

from millrace.functions.registry import kernel, parse

FUNCTIONS = parse("conversion", r"""
tointeger(s STRING) BIGINT = CASE WHEN trim(s) RLIKE '^[+-]?[0-9]+([.]0*)?$' THEN try_cast(regexp_replace(trim(s), '[.].*', '') AS BIGINT) WHEN trim(s) RLIKE '^0[xX][0-9A-Fa-f]{1,15}$' THEN CAST(conv(substr(trim(s), 3), 16, 10) AS BIGINT) END ;; tointeger(CAST(o_custkey AS STRING)) ;; o_custkey
toreal(s STRING) DOUBLE = try_cast(trim(s) AS DOUBLE) ;; toreal(CAST(o_totalprice AS STRING)) ;; o_totalprice
try_to_double(s STRING) DOUBLE = try_cast(s AS DOUBLE) ;; try_to_double(o_orderpriority) ;; TRY_CAST(o_orderpriority AS DOUBLE)
try_to_decimal(s STRING) DECIMAL(38, 10) = try_cast(s AS DECIMAL(38, 10)) ;; CAST(try_to_decimal(CAST(o_custkey AS STRING)) AS DOUBLE) ;; CAST(o_custkey AS DOUBLE)
try_to_numeric(s STRING) DECIMAL(38, 10) = try_cast(s AS DECIMAL(38, 10))
try_to_boolean(s STRING) BOOLEAN = try_cast(s AS BOOLEAN) ;; try_to_boolean(if(o_orderstatus = 'F', 'true', 'maybe')) ;; CASE WHEN o_orderstatus = 'F' THEN true END
to_boolean(s STRING) BOOLEAN = try_cast(s AS BOOLEAN)
to_double(s STRING) DOUBLE = try_cast(s AS DOUBLE)
to_decimal(s STRING) DECIMAL(38, 10) = try_cast(s AS DECIMAL(38, 10))
to_numeric(s STRING) DECIMAL(38, 10) = try_cast(s AS DECIMAL(38, 10))
safe_negate(n BIGINT) BIGINT = try_subtract(0L, n) ;; safe_negate(o_custkey) ;; -o_custkey
to_binary = builtin ;; hex(to_binary(o_orderstatus, 'utf-8')) ;; hex(o_orderstatus)
decimal_cmp(a STRING, b STRING) INT = CAST(signum(CAST(a AS DECIMAL(38, 10)) - CAST(b AS DECIMAL(38, 10))) AS INT) ;; decimal_cmp(CAST(o_custkey AS STRING), '700') ;; CAST(sign(o_custkey - 700) AS INTEGER)
""")

#: Exact decimals in text, with the fraction digits that the operands call for.
EXACT = Context(prec=200)
FUNCTIONS += [
    kernel("conversion", "decimal_add", "string", lambda a, b: format(EXACT.add(Decimal(a), Decimal(b)), "f")),
    kernel("conversion", "decimal_sub", "string", lambda a, b: format(EXACT.subtract(Decimal(a), Decimal(b)), "f")),
    kernel("conversion", "decimal_mul", "string", lambda a, b: format(EXACT.multiply(Decimal(a), Decimal(b)), "f")),
]
