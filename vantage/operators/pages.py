"""Pages of results that are worked out once and then replayed, and rows that expire."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Pages:
    """Pages under a folder that all executors share, by token, for one scope (place, radius, date and the like).

    A page is a table that is written whole and then named, so that a token gives the same rows whenever it is asked,
    whoever else asks meanwhile. Another scope, an unknown token and a page older than ``ttl`` seconds are errors.
    """

    def __init__(self, spark: SparkSession, root: str, scope: dict, ttl: float = 3600.0):
        self.spark, self.root, self.scope, self.ttl = spark, root.rstrip("/"), json.dumps(scope, sort_keys=True), ttl
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, token: str) -> str:
        if not re.fullmatch("[0-9a-f]{32}", token):
            raise ValueError("not a page's token")
        return f"{self.root}/{token}"

    def _named(self, rows: DataFrame, path: str) -> None:
        part = f"{path}.{uuid.uuid4().hex}"
        rows.write.parquet(part)
        # Of two that write one page, the second finds it there and drops its own.
        if self._fs.exists(self._path(path)) or not self._fs.rename(self._path(part), self._path(path)):
            self._fs.delete(self._path(part), True)

    def opened(self) -> str:
        """The token of a new page, which is not worked out yet."""
        token = uuid.uuid4().hex
        now = F.unix_micros(F.current_timestamp()) / 1e6
        self._named(self.spark.range(1).select(F.lit(self.scope).alias("scope"), now.alias("created")), f"{self._at(token)}-scope")
        return token

    def page(self, token: str, make: Callable[[], DataFrame], now: float | None = None) -> DataFrame:
        """The page's rows: those of ``make`` the first time, and the same ones ever after."""
        import time

        path = self._at(token)
        if not self._fs.exists(self._path(f"{path}-scope")):
            raise ValueError("there is no such page")
        own = self.spark.read.parquet(f"{path}-scope").first()
        if own.scope != self.scope:
            raise ValueError("the page belongs to another scope")
        if (time.time() if now is None else now) - own.created > self.ttl:
            raise ValueError("the page has expired")
        if not self._fs.exists(self._path(path)):
            self._named(make(), path)
        return self.spark.read.parquet(path)


def unexpired(rows: DataFrame, touched: str, now: float, seconds: float) -> DataFrame:
    """The rows whose time (seconds) is no more than so long ago."""
    return rows.where(F.lit(now) - F.col(touched) <= seconds)


def latest(rows: DataFrame, key: str, touched: str) -> DataFrame:
    """The row of each key that was stored last; aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, touched)]
    return rows.groupBy(key).agg(F.max(F.struct(touched, *rest)).alias("_b")).select(key, f"_b.{touched}", *(f"_b.{c}" for c in rest))
