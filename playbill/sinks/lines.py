"""Ordered text at any size.

A document is a table of lines with sort columns.  It is range-partitioned
and sorted, so the part files, read in name order, are the document; no task
or driver holds it whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, order: Sequence[str | Column],
                line: str = "line", by: Sequence[str] = (), sep: str = "\n") -> None:
    """Write ``line`` in ``order``; with ``by`` one folder per value, whose
    part files are again in order."""
    sort = [*by, *order]
    placed = lines.repartitionByRange(*sort).sortWithinPartitions(*sort)
    out = placed.select(*by, F.col(line).alias("value"))
    writer = out.write.mode("overwrite").option("lineSep", sep)
    (writer.partitionBy(*by) if by else writer).text(path)
