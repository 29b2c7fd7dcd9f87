"""Email addresses and keyed hashes."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_email(email: Column) -> Column:
    """Trimmed and in lower case; a tag after + stays, as it may be another person."""
    return F.lower(F.trim(email))


def valid_email(email: Column) -> Column:
    """3 to 320 characters with one @, something before it, and behind it a dot that is neither first nor last, and no space."""
    e = F.btrim(email, F.lit(" \t\n\r\x0b\x0c"))
    domain = F.substring_index(e, "@", -1)
    one = (F.length(e) - F.length(F.replace(e, F.lit("@"), F.lit("")))) == 1
    fine = F.contains(domain, F.lit(".")) & ~F.startswith(domain, F.lit(".")) & ~F.endswith(domain, F.lit(".")) & ~F.contains(e, F.lit(" "))
    return F.coalesce(F.length(e).between(3, 320) & one & ~F.startswith(e, F.lit("@")) & fine, F.lit(False))


def mailbox(email: Column) -> Column:
    """Without a tag: what may be the same person's."""
    return F.concat(F.substring_index(F.substring_index(normal_email(email), "@", 1), "+", 1), F.lit("@"), F.substring_index(normal_email(email), "@", -1))


def keyed_hash(value: Column, pepper: str) -> Column:
    """Hex HMAC-SHA256; Spark has no function for it, so batches go through Arrow. Null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(pepper.encode(), v.encode(), hashlib.sha256).hexdigest())

    return run(value.cast("string"))
