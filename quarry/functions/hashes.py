"""Content hashes: XXH3 of 128 bits as 32 lower-case hex digits, which Spark has no function for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def content_hash(content: pd.Series) -> pd.Series:
    """Hash of bytes; null stays null."""
    import xxhash

    return content.map(lambda b: None if b is None else xxhash.xxh3_128_hexdigest(b))


@F.pandas_udf(StringType())
def file_hash(content: pd.Series, mtime: pd.Series) -> pd.Series:
    """Hash of bytes followed by the seconds of the last change as 8 little-endian bytes: a touched file has another hash."""
    import xxhash

    return pd.Series([None if b is None or pd.isna(t) else xxhash.xxh3_128_hexdigest(bytes(b) + int(t).to_bytes(8, "little")) for b, t in zip(content, mtime, strict=True)], dtype=object)
