"""Post links inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipledger.constants import LINK_PATTERN, MAX_U64


def _number(digits: Column) -> Column:
    value = F.when(digits.rlike("^[0-9]+$"), digits.try_cast("decimal(38,0)"))
    return F.when(value <= F.lit(MAX_U64).cast("decimal(38,0)"), value.cast("decimal(20,0)"))


def post_id(link: Column) -> Column:
    """The link's id as an unsigned 64-bit number, else null; only ASCII digits count."""
    return _number(F.regexp_extract(link, LINK_PATTERN, 2))


def link_matches(text: str | Column) -> Column:
    """Every match of the link pattern in order, with usable ids only."""
    found = F.regexp_extract_all(text, F.lit(LINK_PATTERN), F.lit(0))
    return F.filter(found, lambda m: post_id(m).isNotNull())


def link_ids(text: str | Column) -> Column:
    """The usable ids of all matches in order; the text is searched once."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(LINK_PATTERN), F.lit(2)), _number), lambda i: i.isNotNull())
