"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]


# P17
def parse_iso_timestamp(s: Column) -> Column:
    """ISO-8601 text to timestamp; unparseable text becomes null (rejected later by F1)."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ISO_FORMATS])
