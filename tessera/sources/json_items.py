"""Bounded scans of one huge JSON array or object, however few lines it has.

Spark splits the file at a closing bracket, which may stand inside a text or end
an inner value.  Whether it does depends on all characters before it, yet each
piece only acts on a small state (inside a text or not, depth of brackets), and
such actions compose.  So the pieces of a split are summed up to what the split
does from either state, the splits' sums are run through in the order of the
file, and then each piece knows the state it begins in.  A piece that closes at
depth one ends an item.  No task holds more than a split and its items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pieces(spark: SparkSession, path: str, close: str) -> DataFrame:
    """``file``, ``split``, ``seq``, ``piece``: the text between closing brackets, in order of ``seq`` within a split."""
    lines = spark.read.option("lineSep", close).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("piece"))


def depth_change(text: Column) -> Column:
    """Opening less closing brackets outside of texts, for a text that begins outside of one."""
    bare = F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), '".*$', "")
    return F.length(F.regexp_replace(bare, r"[^\[{]+", "")) - F.length(F.regexp_replace(bare, r"[^\]}]+", ""))


def actions(rows: DataFrame) -> DataFrame:
    """Adds ``quotes`` (odd: the piece changes sides) and ``from_out``, ``from_in``: its change of depth from either side, its own bracket included."""
    # a line break would end what the patterns call a line; an escaped character never ends a text
    text = F.regexp_replace(F.regexp_replace("piece", r"[\r\n]+", " "), r"\\.", "")
    rows = rows.withColumn("text", text).withColumn("quotes", F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit(""))))
    odd = F.col("quotes") % 2
    after = F.when(F.col("quotes") > 0, depth_change(F.regexp_replace("text", '^[^"]*"', ""))).otherwise(0)
    return rows.withColumn("from_out", depth_change(F.col("text")) - F.when(odd == 0, 1).otherwise(0)).withColumn("from_in", after - F.when(odd == 1, 1).otherwise(0)).drop("text")


def items(spark: SparkSession, path: str, close: str = "}") -> DataFrame:
    """``file``, ``split``, ``item`` (both number items in the order of the file), ``value``: the text of each item of the arrays or objects in the files, its comma taken off.

    ``close`` is the bracket that ends an item: that of an array of objects, or of
    an object of arrays with ``]``.  Several arrays may follow each other in one
    file.  An item of another kind joins the next one.  Empty files and arrays
    have no item.
    """
    within = Window.partitionBy("file", "split").orderBy("seq")
    rows = actions(pieces(spark, path, close))
    # sides at the start of a piece, counted from the start of its split
    rows = rows.withColumn("turns", (F.sum("quotes").over(within) - F.col("quotes")) % 2)
    stays = rows.select("file", "split", "quotes", F.when(F.col("turns") == 0, F.col("from_out")).otherwise(F.col("from_in")).alias("out"), F.when(F.col("turns") == 0, F.col("from_in")).otherwise(F.col("from_out")).alias("in"))
    splits = stays.groupBy("file", "split").agg((F.sum("quotes") % 2).alias("q"), F.sum("out").alias("out"), F.sum("in").alias("in"))  # a row for each split
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("side", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    splits = splits.withColumn("depth", F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("out")).otherwise(F.col("in"))).over(before), F.lit(0)))
    rows = rows.join(splits.select("file", "split", "side", "depth"), ["file", "split"])
    inside = (F.col("turns") + F.col("side")) % 2
    rows = rows.withColumn("outside_after", (inside + F.col("quotes")) % 2 == 0)
    change = F.when(inside == 0, F.col("from_out")).otherwise(F.col("from_in"))
    rows = rows.withColumn("after", F.col("depth") + F.sum(change).over(within)).withColumn("ends", (F.col("outside_after") & (F.col("after") == 1)).cast("long"))
    rows = rows.withColumn("item", F.sum("ends").over(within) - F.col("ends"))
    # what follows the last end of a split belongs to the first item that ends in a later one
    ended = rows.groupBy("file", F.col("split").alias("at")).agg(F.sum("ends").alias("n"))
    following = Window.partitionBy("file").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    ended = ended.withColumn("next", F.min(F.when(F.col("n") > 0, F.col("at"))).over(following))
    rows = rows.join(ended.withColumnRenamed("at", "split"), ["file", "split"])
    mine = F.col("item") < F.col("n")
    rows = rows.where(mine | F.col("next").isNotNull()).select("file", F.when(mine, F.col("split")).otherwise(F.col("next")).alias("owner"), F.when(mine, F.col("item")).otherwise(0).alias("item"), F.struct("split", "seq", "piece", (F.col("after") - change).alias("depth")).alias("p"))
    found = rows.groupBy("file", F.col("owner").alias("split"), "item").agg(F.array_sort(F.collect_list("p")).alias("p"))  # the pieces of one item
    text = F.concat(F.array_join(F.transform("p", lambda p: p["piece"]), close), F.lit(close))
    # before an item stand the bracket that its array begins with, or a comma, or the end of one array and the start of another
    again = r"(?:[\]}]\s*[\[{]\s*)*"
    first = F.regexp_replace(text, rf"^\s*[\[{{]\s*{again}", "")
    later = F.regexp_replace(text, rf"^[\s,]*{again}", "")
    return found.select("file", "split", "item", F.when(F.col("p")[0]["depth"] == 0, first).otherwise(later).alias("value"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a JSON array as rows, in any number of files; a broken object gives a row of nulls."""
    return items(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_json_lists(spark: SparkSession, path: str) -> DataFrame:
    """``key``, ``values`` of a JSON object whose values are lists of texts."""
    entry = F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "map<string,array<string>>")
    return items(spark, path, "]").select(F.explode(entry).alias("key", "values"))
