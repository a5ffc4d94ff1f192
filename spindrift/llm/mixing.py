"""Mixing sources to target weights by hash-random order and distributed prefix sums of their sizes.

Every document gets a random key from its hash. The keys' range is cut into equal buckets, whose sizes are summed and added up
along each source. A source's budget ends in one of its buckets; only that bucket is sorted, and
all others are taken or left whole. So neither a source nor the corpus is ever sorted in one place. Rows that agree in key, id, size and
text are counted before they are sorted; if the budget ends among them, as many as fit are taken, told apart by the partitions that they lie in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.staging import discard, staged

#: Weights by the sources' order, again and again, and the most times that a source is repeated.
WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
KEY_BITS = 60


def word_count(text: str) -> Column:
    """Number of runs of characters other than the white space of ASCII; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(*columns: str) -> Column:
    """A number of ``KEY_BITS`` bits from the MD5 of the columns' text."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row a source.

    Sources in the order of their code points, null last, share the total by weight. A share stops at ``most`` times its source's
    size and the excess goes to the rest by weight. With sources in ascending order of size over weight, those that stop come
    first, and the level at which the first of the others stands is everyone's.
    """
    placed = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(placed) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    level = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("level", level).withColumn("stops", F.col("level") > F.col("limit") / F.col("weight"))
    shared = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    target = F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("weight") * shared)
    return rows.select("source", "source_size", target.alias("target"))


#: What orders the rows of a bucket: the random key, then whatever tells rows of one key apart.
ORDER = ("key", "id", "size", "of_text")


def cuts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> tuple[DataFrame, DataFrame]:
    """The rows' ``(id, source, size, of_text, key)``, and for each source where its budget ends.

    The second table has ``(source, source_size, target, whole, cut, last, part, alike)``: whole times the source is taken, and once more the
    buckets before ``cut`` and in it what comes before ``last``, and of the ``alike`` rows that are ``last`` themselves ``part``; all of them if ``cut`` is null.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_col).alias("of_text"))
    rows = staged(rows.withColumn("key", random_key("id", "size")), "sizes")
    # As many buckets as rows in the bucket of a source that has all rows, so that neither becomes a long task.
    bits = math.ceil(math.log2(max(1, rows.count())) / 2)
    bucketed = rows.withColumn("bucket", F.shiftright("key", KEY_BITS - bits))
    buckets = staged(bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("held")), "buckets")
    goals = targets(buckets.groupBy("source").agg(F.sum("held").alias("source_size")), weights, most)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    goals = goals.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))

    so_far = Window.partitionBy("b.source").orderBy("bucket")
    ends = buckets.alias("b").withColumn("end", F.sum("held").over(so_far)).join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
    first = F.min(F.when(F.col("end") > F.col("left"), F.struct("bucket", (F.col("end") - F.col("held")).alias("before"))))
    goals = ends.groupBy(F.col("g.source").alias("source")).agg(*[F.first(f"g.{c}").alias(c) for c in ("source_size", "target", "whole", "left")], first.alias("cut"))
    goals = staged(goals.select("source", "source_size", "target", "whole", "left", F.col("cut.bucket").alias("cut"), "cut.before"), "goals")

    near = bucketed.alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")) & (F.col("bucket") == F.col("cut"))).select("r.*", "left", "before")
    alike = near.groupBy("source", "left", "before", *ORDER).agg(F.count(F.lit(1)).alias("alike"))
    ahead = Window.partitionBy("source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("alike")).over(ahead), F.lit(0))
    # A row fits if its middle lies within what is left: twice its start and its size are at most twice that, in whole numbers.
    room = F.floor(2 * F.col("left")).cast("long") - F.col("size") - 2 * F.col("start")
    fits = F.when(room < 0, 0).when(F.col("size") == 0, F.col("alike")).otherwise(F.least("alike", F.floor(room / (2 * F.nullif("size", F.lit(0)))) + 1)).cast("long")
    fitting = alike.withColumn("start", start).withColumn("part", fits).where("part > 0")
    lasts = fitting.groupBy("source").agg(F.max(F.struct(F.struct(*ORDER).alias("last"), "part", "alike")).alias("l")).select("source", "l.*")
    joined = goals.alias("g").join(lasts.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")), "left")
    found = staged(joined.select("g.source", "source_size", "target", "whole", "cut", "last", "part", "alike"), "cuts").withColumn("bits", F.lit(bits))
    for table in (buckets, goals):
        discard(table)
    return rows, found


def _copies(table: DataFrame, goals: DataFrame, source: str) -> DataFrame:
    """``table``, which has the columns of ``ORDER``, with its source's columns and ``copies``."""
    goals = goals.withColumnRenamed("source", "__goal")
    told = table.join(goals, table[source].eqNullSafe(goals["__goal"])).drop("__goal")
    bucket = F.expr(f"shiftright(key, {KEY_BITS} - bits)")
    inside = F.coalesce(F.struct(*ORDER) <= F.col("last"), F.lit(False))
    more = F.col("cut").isNull() | (bucket < F.col("cut")) | ((bucket == F.col("cut")) & inside)
    told = told.withColumn("copies", F.col("whole") + more.cast("long"))
    if goals.where("part < alike").isEmpty():
        return told
    split = F.coalesce((F.col("part") < F.col("alike")) & F.struct(*ORDER).eqNullSafe(F.col("last")), F.lit(False))
    tied = _ranked(told.where(split), source).withColumn("copies", F.col("whole") + (F.col("__rank") < F.col("part")).cast("long")).drop("__rank")
    return told.where(~split).unionByName(tied)


def _ranked(rows: DataFrame, source: str) -> DataFrame:
    """``rows`` with ``__rank``, a place from 0 within their source, by the partitions' counts and the place within a partition."""
    rows = staged(rows.withColumn("__part", F.spark_partition_id()), "tied-rows")
    before = Window.partitionBy(source).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(source, "__part").agg(F.count(F.lit(1)).alias("n")).withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    firsts = firsts.select(F.col(source).alias("__s"), F.col("__part").alias("__p"), "__first")
    within = F.row_number().over(Window.partitionBy(source, "__part").orderBy(F.lit(0))) - 1
    placed = rows.withColumn("__within", within).join(firsts, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p")))
    return placed.withColumn("__rank", F.col("__first") + F.col("__within")).drop("__s", "__p", "__part", "__first", "__within")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """``(id_col, source_col, size, source_size, target, copies, taken)`` of every row.

    Size is the number of words. A source is taken as many whole times as its target holds, and then its documents in the order
    of their random keys, each as long as its middle lies within what is left of the target. ``taken`` is
    ``copies`` times the size. So a source misses its target by half a document at most, and documents stay whole.

    A null source is a source of its own, a null or empty text has size 0 and takes nothing. The random key is that of the id
    and size, and rows that share both follow the hash of their text, so reruns agree; rows alike in all of that are taken one by one and are
    interchangeable. Null ids take part. Columns beside the three named play no part. An empty table gives an empty result. The sources, one row each, are
    ranked in one task, which is meant for up to some millions of them.
    """
    rows, goals = cuts(docs, id_col, text_col, source_col, weights, most)
    out = _copies(rows, goals, "source")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with all their columns; the texts themselves aren't shuffled."""
    rows, goals = cuts(docs, id_col, text_col, source_col, weights, most)
    discard(rows)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("of"), word_count(text_col).alias("size"), F.xxhash64(text_col).alias("of_text"))
    out = _copies(row.withColumn("key", random_key("id", "size")), goals, "of").where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
