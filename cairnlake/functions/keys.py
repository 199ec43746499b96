"""Normal forms of hashes and paths, so that differently written keys meet in joins."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Modes of a tree entry that mean a directory.
DIRECTORY_MODES = ("directory", "040000")


def norm_hash(c: Column) -> Column:
    """A hash as lower-case digits: white space and an algorithm name with a colon are dropped, empty means null."""
    plain = F.lower(F.regexp_replace(c, r"(?U)^\s*(?:[^\s:]+\s*:)?\s*|\s+$", ""))
    return F.nullif(plain, F.lit(""))


@F.arrow_udf(StringType())
def nfc(paths: pa.Array) -> pa.Array:
    """Unicode composition (NFC); a batch of plain ASCII passes untouched, else only the other values are composed."""
    plain = pc.fill_null(pc.string_is_ascii(paths), True)
    if pc.all(plain).as_py():
        return paths
    other = pc.invert(plain)
    composed = [unicodedata.normalize("NFC", p) for p in pc.filter(paths, other).to_pylist()]
    return pc.replace_with_mask(paths, other, pa.array(composed, paths.type))


def norm_path(c: Column) -> Column:
    """A path with single forward slashes, no leading ``./`` and composed characters.  Letter case stays; null stays."""
    slashes = F.regexp_replace(F.translate(c, "\\", "/"), "/+", "/")
    return nfc(F.regexp_replace(slashes, r"^(?:\./)+", ""))


def is_directory(mode: Column) -> Column:
    """Whether the mode of a tree entry means a directory (null: no)."""
    return F.coalesce(F.lower(F.trim(mode)).isin(*DIRECTORY_MODES), F.lit(False))
