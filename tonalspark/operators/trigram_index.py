"""Search by trigrams from posting lists that are written once: a query reads a few lists, never the items."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import scratch


@dataclass
class TrigramIndex:
    """path: ``postings`` (gram, field, size, item, title, artist, popularity), sorted by gram, ``lengths`` (gram, field, n) and
    ``items`` for queries that have no trigram."""

    spark: SparkSession
    path: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/items")

    def lengths(self, grams: list[str]) -> dict[tuple[str, str], int]:
        rows = self.spark.read.parquet(f"{self.path}/lengths").where(F.col("gram").isin(grams)).collect()  # two rows a gram at most
        return {(r["field"], r["gram"]): r["n"] for r in rows}


def build(items: DataFrame, path: str | None = None) -> TrigramIndex:
    """Posting lists of the trigrams of ``items`` (item, title, artist, popularity), at ``path`` or in the shared folder.

    A posting holds its item's texts, so what a list finds can be judged without the items. Lists are cut into files by gram and item:
    one that a third of all items share is spread over as many files as its length takes, and files of other lists are told by
    their bounds.
    """
    spark = items.sparkSession
    path = path or scratch(spark, "trigrams")
    rows = items.select("item", "title", "artist", "popularity")
    rows.write.parquet(f"{path}/items")
    rows = spark.read.parquet(f"{path}/items")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), T.trigrams(F.col(f)).alias("grams")) for f in ("title", "artist")])
    flat = rows.withColumn("f", F.explode(fields)).select(F.explode("f.grams").alias("gram"), F.col("f.field").alias("field"), F.size("f.grams").alias("size"), *rows.columns)
    flat.repartitionByRange("gram", "field", "item").sortWithinPartitions("gram", "field", "item").write.parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("gram", "field").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/lengths")
    return TrigramIndex(spark, path)


def _grams(spark: SparkSession, query: str) -> tuple[list[str], list[str]]:
    """The trigrams of a query, and those that any text around it has too: within its words, without the padding."""
    words, grams = spark.range(1).select(T.tokens(F.lit(query)), T.trigrams(F.lit(query))).first()
    return grams or [], sorted({w[i : i + 3] for w in words or [] for i in range(len(w) - 2)})


def candidates(index: TrigramIndex, query: str, least: float = 0.3) -> DataFrame:
    """(item, title, artist, popularity) of items that may hold the query or be alike.

    Two sets of q and n trigrams with a Jaccard of ``least`` have c = ceil(least q) trigrams of the query in common, and n lies between
    least q and q / least: such an item is in one of any q - c + 1 of the query's lists, of which the shortest are read. A text that
    holds the query is in all lists of the trigrams within its words; the shortest of them is read.
    """
    grams, inner = _grams(index.spark, query)
    if not grams:
        return index.items if query.strip() else index.items.where("false")
    lengths, found, postings = index.lengths(sorted({*grams, *inner})), F.lit(False), index.postings
    for field in ("title", "artist"):
        by_length = sorted(grams, key=lambda g: (lengths.get((field, g), 0), g))
        rare = by_length[: len(grams) - math.ceil(least * len(grams) - 1e-9) + 1]
        sizes = F.col("size").between(math.ceil(least * len(grams) - 1e-9), math.floor(len(grams) / least + 1e-9))
        found = found | ((F.col("field") == field) & F.col("gram").isin(rare) & sizes)
        if inner:
            found = found | ((F.col("field") == field) & (F.col("gram") == min(inner, key=lambda g: (lengths.get((field, g), 0), g))))
    hits = postings.where(F.col("gram").isin(sorted({*grams, *inner}))).where(found).select("item", "title", "artist", "popularity")
    if not inner:  # a query of words of one or two letters: what holds it has no list of its own
        low = query.lower()
        hits = hits.unionByName(index.items.where(F.lower("title").contains(low) | F.lower("artist").contains(low)))
    return hits.dropDuplicates(["item"])


def search(index: TrigramIndex, query: str, limit: int, least: float = 0.3) -> DataFrame:
    """(item, similarity) of the items whose title or artist holds the query or has a Jaccard of trigrams of ``least`` with it: the
    ``limit`` likest, ties to the more popular, then to the smaller item. The same as judging every item."""
    q, low = T.trigrams(F.lit(query)), query.lower()
    like = F.greatest(T.jaccard(T.trigrams(F.col("title")), q), T.jaccard(T.trigrams(F.col("artist")), q))
    judged = candidates(index, query, least).withColumn("similarity", like)
    found = judged.where((F.col("similarity") >= least) | F.lower("title").contains(low) | F.lower("artist").contains(low))
    return found.orderBy(F.col("similarity").desc(), F.col("popularity").desc_nulls_last(), "item").limit(limit).select("item", "similarity")
