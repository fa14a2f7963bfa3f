"""Line numbers of files that come in pieces.

A file that is too large for one task is several rows ``(repo, path, chunk, content)`` that end at
line ends.  The lines before a piece are the sum over the pieces before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewarden.functions.text import line_count


def with_first_lines(whole: DataFrame, large: DataFrame) -> DataFrame:
    """Files with ``first_line`` of each piece; content is null where the file is no UTF-8.

    ``whole`` are files of one piece, ``large`` the pieces of others.  These are read once more
    to be counted, and shuffled, which deals one file out to several tasks.  A newline is never
    part of another character, so a file is valid if its pieces are.
    """
    whole = whole.withColumn("first_line", F.lit(0).cast("long"))
    text = F.col("content").cast("string")
    counted = large.select(
        "repo", "path", "chunk", line_count(text).cast("long").alias("n"),
        F.coalesce(F.is_valid_utf8(text), F.lit(False)).alias("valid"),
    )
    file = Window.partitionBy("repo", "path")
    places = counted.select(
        "repo", "path", "chunk", F.min("valid").over(file).alias("readable"),
        (F.sum("n").over(file.orderBy("chunk")) - F.col("n")).alias("first_line"),
    )
    # the pieces of a file come from one task; with a number, so that they are not put together again
    tasks = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = large.repartition(tasks, "repo", "path", "chunk")
    # as a shuffled join, since a broadcast of small pieces would gather them again
    pieces = dealt.join(places.hint("shuffle_hash"), ["repo", "path", "chunk"]).withColumn(
        "content", F.when(F.col("readable"), F.col("content"))
    )
    return whole.unionByName(pieces.select(whole.columns))
