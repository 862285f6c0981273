"""A substring index over a text column: trigram postings as bitmaps, candidates by intersection, exact matching after.

Rows are numbered. The postings of a trigram are words of 64 bits, a bit a row, so a row of the postings table stands for 64
rows of the table, and intersecting trigrams is a ``bit_and`` of numbers. Texts lie in blocks by number, a folder each, so
that only blocks with a candidate are read; postings lie in folders by the hash of their trigram. A needle takes its
``RAREST`` trigrams, as many as narrow candidates down about as far as all of them; what they let through in error does not
survive the exact match. Needles of fewer than three characters are in no trigram and scan.

Upper and lower case are the same, as in the search without an index. Null texts and empty needles match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larkspur.operators.numbering import numbered
from larkspur.sources.work import if_small, new_path, written

GRAM, BITS, RAREST = 3, 64, 8
#: Rows of needles' trigrams, and candidates, up to which they are broadcast.
FEW = 100_000


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, in one pass over its characters."""
    return F.transform(F.array(F.split(F.lower(text), "")), _windows)[0]


def _windows(chars: Column) -> Column:
    n = F.size(chars)
    at = F.when(n >= GRAM, F.sequence(F.lit(0), n - GRAM)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)])))


@dataclass
class TextIndex:
    """Tables: rows (block, n, and the columns), postings (g, gram, word, bits), sizes (gram, words)."""

    spark: SparkSession
    path: str
    text: str
    columns: list[str]
    folders: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def sizes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sizes")

    def _folder(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.folders)).cast("int")

    def candidates(self, needles: DataFrame) -> DataFrame:
        """(needle, n): rows that have the rarest trigrams of each needle, a text of three characters or more."""
        asked = needles.where(F.length("needle") >= GRAM).select("needle").distinct()
        asked = written(asked.select("needle", F.explode(grams(F.col("needle"))).alias("gram")), "index-asked")
        sized = asked.join(self.sizes, "gram", "left").withColumn("words", F.coalesce("words", F.lit(0)))
        rare = sized.withColumn("nth", F.row_number().over(Window.partitionBy("needle").orderBy("words", "gram"))).where(F.col("nth") <= RAREST)
        rare = written(rare.withColumn("of", F.count("*").over(Window.partitionBy("needle"))).select("needle", "gram", "of"), "index-rare")
        folders = [r.g for r in rare.select(self._folder(F.col("gram")).alias("g")).distinct().collect()]  # of a fixed number
        met = self.postings.where(F.col("g").isin(folders)).join(if_small(rare, FEW), "gram")
        both = met.groupBy("needle", "of", "word").agg(F.count("*").alias("k"), F.bit_and("bits").alias("bits")).where("k = of AND bits <> 0")
        places = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
        return both.select("needle", "word", F.explode(places).alias("place")).select("needle", (F.col("word") * BITS + F.col("place")).alias("n"))

    def search(self, needles: DataFrame) -> DataFrame:
        """(needle, columns): the rows that hold each needle, upper and lower case being the same."""
        found = written(self.candidates(needles), "index-candidates")
        rows = self.rows
        # blocks are of a fixed number
        blocks = [r.b for r in found.select((F.col("n") % self.folders).cast("int").alias("b")).distinct().collect()]
        hit = F.contains(F.lower(F.col(self.text)), F.lower("needle"))
        met = rows.where(F.col("block").isin(blocks)).join(if_small(found, FEW), "n").where(hit)
        short = needles.where((F.length("needle") < GRAM) & (F.col("needle") != "")).select("needle").distinct()
        if not short.isEmpty():
            # a stated set of needles, of two characters at most
            met = met.select("needle", *self.columns).unionByName(rows.join(F.broadcast(short), hit).select("needle", *self.columns))
        return met.select("needle", *self.columns)

    def blocks_read(self, needles: DataFrame) -> tuple[int, int]:
        """Rows in the blocks that a search of the needles reads, and all rows."""
        found = self.candidates(needles).select((F.col("n") % self.folders).cast("int").alias("block")).distinct()
        counts = self.rows.groupBy("block").agg(F.count("*").alias("k"))
        read = counts.join(found, "block", "left_semi").agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
        return read, self.rows.count()


def build(df: DataFrame, text: str, order: str, folders: int = 64) -> TextIndex:
    """The index of a column; rows are numbered by ``order``. Its tables are written below the work folder."""
    spark = df.sparkSession
    index = TextIndex(spark, new_path(spark, "text-index"), text, df.columns, folders)
    rows = numbered(df, F.col(order), name="n", start=0).withColumn("block", (F.col("n") % folders).cast("int"))
    rows.hint("rebalance", "block").write.partitionBy("block").parquet(f"{index.path}/rows")
    each = index.rows.select("n", F.explode(grams(F.col(text))).alias("gram"))
    bits = F.bit_or(F.expr(f"shiftleft(1L, cast(n % {BITS} AS INT))")).alias("bits")
    words = each.groupBy("gram", F.floor(F.col("n") / BITS).alias("word")).agg(bits).withColumn("g", index._folder(F.col("gram")))
    words.hint("rebalance", "g").sortWithinPartitions("g", "gram", "word").write.partitionBy("g").parquet(f"{index.path}/postings")
    index.postings.groupBy("gram").agg(F.count("*").alias("words")).write.parquet(f"{index.path}/sizes")
    return index
