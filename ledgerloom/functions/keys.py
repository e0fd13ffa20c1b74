"""Normal forms of ids, dates and spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as a blank around a value.
BLANKS = " \t\r\n\f\v\u00a0\u2007\u202f\u200b\ufeff"

_SOURCE_ID = r"(?:^|[^0-9a-z])([0-9a-f]{10})(?![0-9a-z])"


def folded(c: Column) -> Column:
    """Lower case without outer blanks; null stays null."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def source_key(c: Column) -> Column:
    """``src-`` and ten hex digits, whether written bare, in capitals, with a path, an anchor or as a wikilink.

    Null where the value is null, empty or holds no id.
    """
    digits = F.regexp_extract(F.lower(c), _SOURCE_ID, 1)
    return F.when(digits != "", F.concat(F.lit("src-"), digits))


def day_of(c: Column) -> Column:
    """The date of ``YYYY-MM-DD``, an ISO date-time or ``YYYYmmdd-HHMMSS``; null for anything else."""
    t = F.btrim(c, F.lit(BLANKS))
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1)
    packed = F.regexp_replace(F.regexp_extract(t, r"^(\d{8})(?:$|-\d)", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    text = F.when(iso != "", iso).when(packed != "", packed)
    return text.try_cast("date")


def spelling_key(c: Column) -> Column:
    """Letters and digits in lower case, runs of anything else as one blank: one form for ``A_b``, ``a-B`` and ``a b``."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}]+", " "))
