"""Name an intermediate value inside one column expression.

Catalyst may copy an expression into every place that uses it, above all when a
filter is pushed below the projection that computed it. A value bound here is
computed once per row wherever the whole expression ends up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(values: dict[str, Column], body: Callable[..., Column]) -> Column:
    """Bind several values; ``body`` gets a struct whose fields are the names."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)
