"""Keyed hashes, which no built-in function has."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import functions as F


def hmac_sha256(secret: bytes):
    """A column's keyed hash as upper-case hex; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: hmac.new(secret, v.encode(), hashlib.sha256).hexdigest().upper(), na_action="ignore")

    return run
