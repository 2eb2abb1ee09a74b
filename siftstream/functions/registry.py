"""Functions that users add, callable from SQL and from DataFrame code by name."""

from __future__ import annotations

import inspect
import re

from pyspark.sql import SparkSession

from ..plans import lexicons as L


def register(spark: SparkSession, name: str, function, returns: str | None = None, arguments: str | None = None) -> None:
    """Registers a function for the session.

    function: SQL text over the arguments, which stays in the JVM ("lower(t)", with arguments "t STRING" and returns); a
    class with ``eval``, as a table function with columns ``returns``; a function wrapped by ``udf``, ``pandas_udf`` or
    ``udtf``; or a plain function with ``returns``, called with batches of pandas columns.
    """
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"no name of a function: {name!r}")
    if isinstance(function, str):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments or ''}) RETURNS {returns} RETURN {function}")
    elif inspect.isclass(function):
        from pyspark.sql.functions import udtf

        spark.udtf.register(name, udtf(function, returnType=returns))
    elif type(function).__name__ == "UserDefinedTableFunction":
        spark.udtf.register(name, function)
    elif hasattr(function, "returnType") and hasattr(function, "evalType"):
        spark.udf.register(name, function)
    else:
        from pyspark.sql.functions import pandas_udf

        if not returns:
            raise ValueError("a plain function needs the type that it returns")
        spark.udf.register(name, pandas_udf(function, returns))


def register_own(spark: SparkSession) -> list[str]:
    """Makes the engine's plain text functions callable from SQL; their names."""
    quoted = ", ".join(f"'{v}'" for v in L.FILING_ITEMS)
    own = {
        "signal_trim": ("t STRING", "STRING", r"regexp_replace(t, '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '')"),
        "signal_cut": ("t STRING, n INT", "STRING", "CASE WHEN length(t) <= n THEN t ELSE concat(rtrim(substring(t, 1, n - 1)), '…') END"),
        "signal_filing_item": ("item STRING", "BOOLEAN", f"coalesce(item IN ({quoted}), false)"),
    }
    for name, (arguments, returns, body) in own.items():
        register(spark, name, body, returns, arguments)
    return list(own)
