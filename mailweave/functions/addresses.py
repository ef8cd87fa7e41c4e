"""E-mail address parsing (B6, B7) as regex expressions.

Covers the three common shapes ``"Name" <addr>``, ``Name <addr>`` and a
bare ``addr``. A list is split on every comma (a quoted comma splits too,
as in the reference).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ANGLE = r'^\s*(.*?)\s*<([^>]*)>\s*$'


def _unquote(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1")


def parse_address(v: Column) -> Column:
    """``struct(name, email)``; e-mail case is kept; null stays null."""
    has_angle = v.rlike(ANGLE)
    name = F.when(has_angle, _unquote(F.regexp_extract(v, ANGLE, 1))).otherwise(F.lit(""))
    email = F.when(has_angle, F.trim(F.regexp_extract(v, ANGLE, 2))).otherwise(F.trim(v))
    return F.when(v.isNull(), F.lit(None)).otherwise(
        F.struct(name.alias("name"), email.alias("email")))


def parse_address_list(v: Column) -> Column:
    """Split on commas, parse each, drop empty e-mails, lower-case the
    e-mail and trim the name → ``array<struct<email,name>>``."""
    parts = F.transform(F.split(F.coalesce(v, F.lit("")), ","), lambda x: parse_address(F.trim(x)))
    kept = F.filter(parts, lambda a: a["email"] != "")
    return F.transform(kept, lambda a: F.struct(F.lower(a["email"]).alias("email"),
                                                F.trim(a["name"]).alias("name")))
