"""Call graphs: bounded search from a keyword, rendering, and lookups by position and path.

Edges are rows (ord, head_id, head_label, tail_id, tail_label) with an optional map ``attributes``; ``ord`` is their order in the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.urls import folder, normal_path
from tessera.plans.staging import staged


def search_calls(edges: DataFrame, keyword: str, level: int) -> DataFrame:
    """Edges within ``level`` steps of the nodes whose label holds the keyword, in any case. Rows of the edges with ``level`` and
    ``path``, the order in which they are met.

    Nodes that match as head or tail are the start. Each step goes from heads to tails; a step's nodes are distinct, but nodes of
    earlier steps are met again, so a cycle repeats its edges. A null label matches an empty keyword only. Columns ``level`` and
    ``path`` of the edges give way.
    """
    edges = edges.drop("level", "path")
    match = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(keyword)))
    ends = F.array(F.when(match("head_label"), F.struct(F.col("head_id").alias("id"), F.array((F.col("ord") * 2).cast("long")).alias("path"))), F.when(match("tail_label"), F.struct(F.col("tail_id").alias("id"), F.array((F.col("ord") * 2 + 1).cast("long")).alias("path"))))
    begun = edges.select(F.inline(F.filter(ends, lambda e: e.isNotNull()))).groupBy("id").agg(F.min("path").alias("path"))
    frontier = begun.select(F.col("id").alias("__ts_id"), F.col("path").alias("__ts_path"))
    out = None
    for step in range(1, level + 1):
        if step > 2:  # a step's plan does not hold all steps before it
            frontier = staged(frontier, "frontier")
        met = edges.join(frontier, edges["head_id"] == frontier["__ts_id"]).select(*(edges[c] for c in edges.columns), F.lit(step).alias("level"), F.concat(frontier["__ts_path"], F.array(edges["ord"].cast("long"))).alias("path"))
        out = met if out is None else out.unionByName(met)
        frontier = met.groupBy(F.col("tail_id").alias("__ts_id")).agg(F.min("path").alias("__ts_path"))
    if out is None:
        return edges.limit(0).withColumn("level", F.lit(0)).withColumn("path", F.array().cast("array<bigint>"))
    return out


#: How a graph's text begins.
DOT_HEAD = 'digraph G {\nrankdir=LR;node ["fillcolor"="#eeeeee","style"="filled,rounded","shape"="rect",]'


def dot(edges: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """One row (group, dot) for each group: nodes as they are first met, then all edges, in the order of ``order``.

    A node's attributes are written without a separator; an edge's only if it has some. Without a group, one row: an empty text if
    there are no edges.
    """
    group = group or []
    key = F.struct(*order)
    attributes = F.col("attributes") if "attributes" in edges.columns else F.lit(None).cast("map<string,string>")
    written = F.array_join(F.transform(F.sort_array(F.map_entries(attributes)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('"="'), e["value"], F.lit('",'))), "")
    line = F.concat(F.lit('"'), F.col("head_id"), F.lit('" -> "'), F.col("tail_id"), F.lit('"'), F.when(F.size(attributes) > 0, F.concat(F.lit(" ["), written, F.lit("]"))).otherwise(""))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("head_id").alias("id"), F.col("head_label").alias("label")), F.struct(F.lit(1).alias("side"), F.col("tail_id").alias("id"), F.col("tail_label").alias("label")))
    met = edges.select(*group, key.alias("o"), F.explode(sides).alias("n")).groupBy(*group, "n.id").agg(F.min(F.struct("o", "n.side", "n.label")).alias("first"))
    named = met.withColumn("text", F.concat(F.lit('"'), F.col("id"), F.lit('" ["label"="'), F.coalesce("first.label", F.lit("")), F.lit('"]')))
    joined = lambda df, by, text: df.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by.alias("by"), text.alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    nodes, lines = joined(named, F.struct("first.o", "first.side"), F.col("text")), joined(edges.select(*group, key.alias("o"), line.alias("t")), F.col("o"), F.col("t"))
    if group:
        both = nodes.join(lines.withColumnRenamed("text", "lines"), group)
    else:
        both = nodes.crossJoin(lines.withColumnRenamed("text", "lines"))  # one row each
    full = F.concat(F.lit(DOT_HEAD + "\n"), F.col("text"), F.lit("\n"), F.col("lines"), F.lit("\n}"))
    return both.select(*group, F.when(F.col("lines") == "", "").otherwise(full).alias("dot"))


def code_mapping(edges: DataFrame) -> DataFrame:
    """Each node as it is first met: rows (id, label)."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("head_id").alias("id"), F.col("head_label").alias("label")), F.struct(F.lit(1).alias("side"), F.col("tail_id").alias("id"), F.col("tail_label").alias("label")))
    return edges.select("ord", F.explode(sides).alias("n")).groupBy("n.id").agg(F.min_by("n.label", F.struct("ord", "n.side")).alias("label"))


def enclosing(calls: DataFrame, definitions: DataFrame, bin_size: int = 512) -> DataFrame:
    """For each call (file, pos) the innermost definition (file, name, start, stop) with start <= pos < stop; null outside of any.

    Intervals are dealt to bins of positions, so that the join is an equality on (file, bin); a definition is repeated once for
    each bin that it touches.
    """
    spread = definitions.select(F.col("file").alias("d_file"), "name", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.greatest("stop", F.col("start") + 1) - 1) / bin_size))).alias("d_bin"))
    own = calls.withColumn("__ts_bin", F.floor(F.col("pos") / bin_size))
    inside = (own["file"] == spread["d_file"]) & (own["__ts_bin"] == spread["d_bin"]) & (spread["start"] <= own["pos"]) & (own["pos"] < spread["stop"])
    met = own.join(spread, inside, "left")
    best = F.max(F.when(F.col("d_file").isNotNull(), F.struct("start", (-F.col("stop")).alias("minus"), "name")))
    return met.groupBy(*calls.columns).agg(best.alias("b")).select(*calls.columns, F.col("b.name").alias("enclosing"))


def resolved_modules(imports: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = (".ts", ".js")) -> DataFrame:
    """For each import (file, module) the path of a file (path): relative modules only, the first suffix that exists wins."""
    target = F.when(F.col("module").startswith("."), normal_path(F.concat_ws("/", folder(F.col("file")), F.col("module"))))
    tries = imports.withColumn("__ts_try", F.explode_outer(F.array(*(F.struct(F.lit(i).alias("i"), F.concat(target, F.lit(s)).alias("p")) for i, s in enumerate(suffixes)))))
    met = tries.join(files.select(F.col("path").alias("__ts_path")).distinct(), F.col("__ts_try.p") == F.col("__ts_path"), "left")
    return met.groupBy(*imports.columns).agg(F.min_by("__ts_path", F.when(F.col("__ts_path").isNotNull(), F.col("__ts_try.i"))).alias("resolved"))


def is_definition(nodes: DataFrame, definitions: DataFrame) -> DataFrame:
    """Nodes (file, line, column) at which a definition starts."""
    return nodes.join(definitions.select("file", "line", "column"), ["file", "line", "column"], "left_semi")


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__ts_n", F.row_number().over(w)).where("__ts_n = 1").drop("__ts_n")
