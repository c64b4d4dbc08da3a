"""What an entry file of a program reaches through imports, and where names that files pass on are defined.

Rows are edges of tables that may be of any size: nothing is collected, each round is a join and is written. Imports may be cyclic. A null file or name takes no part; repeated rows count once; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.plans.staging import recorded, remove, scratch, staged


def reached(entries: DataFrame, imports: DataFrame) -> DataFrame:
    """Rows (entry, file, steps): each file that an entry of ``entries`` (entry) imports (``imports``: file, target), directly or through
    others, with the least number of imports on the way; the entry itself has 0. Each round joins only what the last one found new.
    A file of many imports and an entry that reaches many files are plain equi-joins, which adaptive execution splits."""
    spark = imports.sparkSession
    edges = staged(imports.select("file", "target").dropna().distinct(), "imports")
    new = entries.select("entry").dropna().distinct().select("entry", F.col("entry").alias("file"))
    schema, path, steps = new.schema, scratch(spark, "reached"), 0
    while True:
        # a round's rows are a folder of one table, so what was found before is never written again
        new.write.option("compression", "zstd").parquet(f"{path}/steps={steps}")
        new = spark.read.schema(schema).parquet(f"{path}/steps={steps}")
        seen = spark.read.schema(StructType([*schema, StructField("steps", IntegerType())])).parquet(path)
        if new.isEmpty():
            return seen
        steps += 1
        to = new.join(edges, "file").select("entry", F.col("target").alias("file")).distinct()
        new = to.join(seen.select("entry", "file"), ["entry", "file"], "left_anti")


def in_scope(calls: DataFrame, scope: DataFrame, file: str = "file") -> DataFrame:
    """The calls whose file is among the reached ones."""
    return calls.join(scope.select(F.col("file").alias(file)).distinct(), file, "left_semi")


def defined_at(passed: DataFrame, defined: DataFrame) -> DataFrame:
    """Rows (file, name, def_file, def_name): where the name that a file exports is defined. ``passed`` (file, name, target, target_name)
    are names that a file passes on from another, ``defined`` (file, name) those that it defines, which win. A name that is passed on in a
    circle, or from where nobody defines it, has nulls. Two rows of one name: the least target wins.

    Pointer doubling: every round each pointer moves on by as many steps as it has made so far, so a chain of n files takes log2(n)
    rounds. A round that ends no pointer is the last: whoever is farther from a definition would stand behind one that is nearer."""
    spark = passed.sparkSession
    own = defined.select("file", "name").dropna().distinct()
    on = passed.select("file", "name", "target", "target_name").dropna().groupBy("file", "name").agg(F.min(F.struct("target", "target_name")).alias("to"))
    on = on.join(own, ["file", "name"], "left_anti").select("file", "name", F.col("to.target").alias("at_file"), F.col("to.target_name").alias("at_name"), F.lit(False).alias("done"))
    fixed = own.select("file", "name", F.col("file").alias("at_file"), F.col("name").alias("at_name"), F.lit(True).alias("done"))
    with recorded() as folders:
        now = staged(on.unionByName(fixed), "names")
        old, ended = list(folders), -1
        while (count := now.where("done").count()) > ended:
            ended, mark = count, len(folders)
            ahead = now.select(F.col("file").alias("at_file"), F.col("name").alias("at_name"), F.col("at_file").alias("far_file"), F.col("at_name").alias("far_name"), F.col("done").alias("far_done"))
            # a pointer to a name that no row has stays where it is, and never ends
            moved = now.where("not done").join(ahead, ["at_file", "at_name"], "left")
            moved = moved.select("file", "name", F.coalesce("far_file", "at_file").alias("at_file"), F.coalesce("far_name", "at_name").alias("at_name"), F.coalesce("far_done", F.lit(False)).alias("done"))
            now = staged(moved.unionByName(now.where("done")), "names")
            remove(spark, old)
            old = folders[mark:]
    return now.select("file", "name", F.when(F.col("done"), F.col("at_file")).alias("def_file"), F.when(F.col("done"), F.col("at_name")).alias("def_name"))
