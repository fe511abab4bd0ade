"""Names of files as they are: what Spark gives of a file's path is or isn't percent-encoded, by its source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def decode_percents(name: Column) -> Column:
    """``%XX`` decoded; a plus sign stays one, as in paths and unlike in forms."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def metadata_name() -> Column:
    """The name of the file a row was read from, for sources with ``_metadata``, whose paths are encoded."""
    return decode_percents(last_part(F.col("_metadata.file_path")))
