"""Arrow UDFs that are made when they are first used, so that modules can be imported without a session, as workers do."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """A column function that runs the decorated one on pandas Series, batch by batch."""

    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*cols: Column | str) -> Column:
            return F.pandas_udf(f, returns)(*cols)

        return call

    return decorate
