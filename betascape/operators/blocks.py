"""All rows of one table against all rows of another, in blocks of bounded size.

Both tables are dealt into blocks by hash; each pair of blocks is a group of its own that one task reduces to
a few rows for each row of the first table.  Neither table is collected or broadcast, and no pair of rows is
ever a row.  What is shuffled grows with the number of blocks, which the block sizes keep small beside the work.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows of a block of the first and of the second table.
FIRST, SECOND = 50_000, 20_000


def block_join(first: DataFrame, second: DataFrame, reduce: Callable[[pa.Table, pa.Table], pa.Table], schema: str, sizes: tuple[int, int] = (FIRST, SECOND)) -> DataFrame:
    """What ``reduce`` gives for each pair of blocks, neither of them empty.

    Few rows are dealt into more blocks than they need, so that all cores have work.
    """
    context = first.sparkSession.sparkContext
    n, m = first.count(), second.count()
    a = max(1, -(-n // sizes[0]), min(context.defaultParallelism, -(-n // 500)))
    b = max(1, -(-m // sizes[1]))
    deal = lambda df, own, k, other, copies: df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    x, y = deal(first, "__a", a, "__b", b), deal(second, "__b", b, "__a", a)
    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return reduce(left, right)

    return x.groupBy("__a", "__b").cogroup(y.groupBy("__a", "__b")).applyInArrow(run, schema)
