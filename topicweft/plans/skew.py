"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

PIECE = "_piece"


ROWS_PER_PIECE = 2_000_000
FEWEST_ROWS = 50_000


class HotKeys:
    """Keys holding more than ``1/parts`` of the rows, with a piece count each.

    ``counts`` has one row per key and its number of rows ``n``. ``parts`` grows
    with the data: the session's shuffle partitions, or one per two million rows, so a
    piece does not grow. Fewer than ``parts`` keys can be hot; their table is written, so
    that joins with it are broadcast or shuffled by its measured size.
    """

    def __init__(self, counts: DataFrame, key: str, n: str = "n", parts: int | None = None):
        spark = counts.sparkSession
        self.key = key
        top = counts.agg(F.sum(n).alias("total"), F.max(n).alias("largest")).first()
        total = top["total"] or 0
        shuffles = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.parts = parts or max(2, shuffles, total // ROWS_PER_PIECE)
        fewest = max(spark.sparkContext.defaultParallelism, total // FEWEST_ROWS)
        self.width = min(self.parts, fewest)  # partitions worth keeping for this many rows
        self.any = total > 0 and top["largest"] * self.parts > total
        if self.any:
            hot = counts.filter(F.col(n) * self.parts > total).select(
                key, F.ceil(F.col(n) * self.parts / F.lit(float(total))).cast("int").alias("_pieces")
            )
            self.hot = Scratch(spark, "hot").save(hot, "keys")

    @classmethod
    def known(cls, key: str, hot: DataFrame | None) -> HotKeys:
        """Hot keys found before: the table of the keys and their pieces, None without any."""
        self = cls.__new__(cls)
        self.key, self.any, self.hot = key, hot is not None, hot
        return self

    def spread(self, big: DataFrame, *by: str) -> DataFrame:
        """Give each row of the large side its piece, by a hash of ``by``."""
        if not self.any:
            return big
        pieces = F.coalesce("_pieces", F.lit(1))
        return (
            big.join(self.hot, self.key, "left")
            .withColumn(PIECE, F.pmod(F.xxhash64(*by), pieces).cast("int"))
            .drop("_pieces")
        )

    def replicate(self, small: DataFrame) -> DataFrame:
        """One copy of each row of the other side per piece of its key."""
        if not self.any:
            return small
        last = F.coalesce("_pieces", F.lit(1)) - 1
        return (
            small.join(self.hot, self.key, "left")
            .withColumn(PIECE, F.explode(F.sequence(F.lit(0), last)))
            .drop("_pieces")
        )

    @property
    def keys(self) -> list[str]:
        return [self.key, PIECE] if self.any else [self.key]

    def join(
        self, big: DataFrame, small: DataFrame, by: list[str], how: str = "inner", also: tuple[str, ...] = ()
    ) -> DataFrame:
        """``big`` joined to ``small`` on the key and the ``also`` columns; ``by``
        spreads hot rows of ``big``."""
        out = self.spread(big, *by).join(self.replicate(small), [*also, *self.keys], how)
        return out.drop(PIECE)


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
