"""Hashes of records: the same content gives the same hash on every run."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def record_hash(*columns: Column) -> Column:
    """sha256 of the values as JSON; nulls count as such."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])), 256)


def short_id(c: Column, digits: int = 12) -> Column:
    return F.substring(F.sha1(c), 1, digits)


def config_hash(config: dict) -> str:
    return hashlib.sha1(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def in_shard(c: Column, shard: int, of: int) -> Column:
    """Stable membership of an id in one of ``of`` shards: the sha1's first 15 digits, modulo."""
    return F.pmod(F.conv(F.substring(F.sha1(c.cast("string")), 1, 15), 16, 10).cast("bigint"), F.lit(of)) == shard


def signature(key: bytes):
    """HMAC-SHA256 over a canonical text column."""

    @F.pandas_udf("string")
    def sign(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return sign
