"""Decision-impact graph: which decision was followed by later changes to the same files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from whylake import constants as K
from whylake.functions import notes
from whylake.functions.redact import redact
from whylake.functions.text import short_hash
from whylake.operators.ranking import top_n

_BITS = 60  # positions per word; a BIGINT keeps its sign bit free


def _words(scope: int) -> int:
    return -(-scope // _BITS)


def graph_scope(commits: DataFrame, narratives: DataFrame, scope: int = K.GRAPH_SCOPE) -> DataFrame:
    """The newest ``scope`` commits per project with their place in time (``ts`` from 0) and their decision, if any.

    A note in the commit body beats a decision of the narrative.
    """
    newest = top_n(commits, ["project"], [F.col("log_pos").desc()], scope, "_back")
    inside = W.partitionBy("project")
    placed = newest.withColumn("ts", (F.count(F.lit(1)).over(inside) - F.col("_back")).cast("int"))
    generated = narratives.select("project", "sha", F.get("decisions", F.lit(0)).alias("_generated"))
    authored = F.get(notes.decisions(F.col("body")), F.lit(0))
    return (
        placed.withColumn("_authored", authored)
        .join(generated, ["project", "sha"], "left")
        .select(
            "project", "sha", "date", "subject", "ts",
            F.coalesce("_authored", "_generated").alias("text"),
            F.when(F.col("_authored").isNotNull(), "breadcrumb")
            .when(F.col("_generated").isNotNull(), "narrative").otherwise("change").alias("kind"),
        )
    )


def _bit(position: Column, word: int) -> Column:
    shifted = F.call_function("shiftleft", F.lit(1).cast("bigint"), position - word * _BITS)
    return F.when((position >= word * _BITS) & (position < (word + 1) * _BITS), shifted).otherwise(F.lit(0).cast("bigint"))


def _later(position: Column, word: int) -> Column:
    """Mask of the places in ``word`` that come after ``position``."""
    full = F.lit((1 << _BITS) - 1).cast("bigint")
    behind = F.greatest(F.lit(0), F.least(F.lit(_BITS), position + 1 - word * _BITS))
    return F.call_function("shiftleft", F.call_function("shiftright", full, behind), behind)


def _reach(scope_rows: DataFrame, files: DataFrame, scope: int) -> DataFrame:
    """For every decision the set of later commits that share a file with it.

    The set is a bitmap over the at most ``scope`` places of the project, so a file touched by every commit costs one
    row, not one row per pair of commits; both aggregations combine on the map side.
    """
    words = range(_words(scope))
    touched = files.select("project", "sha", "file").join(
        scope_rows.select("project", "sha", "ts", (F.col("kind") != "change").alias("decides")), ["project", "sha"])
    masks = touched.groupBy("project", "file").agg(*[F.bit_or(_bit(F.col("ts"), w)).alias(f"m{w}") for w in words])
    deciding = touched.filter("decides").select("project", "file", "sha", "ts")
    reach = deciding.join(masks, ["project", "file"]).groupBy("project", "sha", "ts").agg(
        *[F.bit_or(f"m{w}").alias(f"m{w}") for w in words])
    all_decisions = scope_rows.filter("kind <> 'change'").select("project", "sha", "ts")
    reach = all_decisions.join(reach, ["project", "sha", "ts"], "left")
    later = reach.withColumns(
        {f"m{w}": F.coalesce(F.col(f"m{w}"), F.lit(0).cast("bigint")).bitwiseAND(_later(F.col("ts"), w)) for w in words})
    degree = sum((F.bit_count(f"m{w}") for w in words), F.lit(0))
    return later.withColumn("out_degree", degree.cast("bigint"))


def decision_graph(
    commits: DataFrame, files: DataFrame, narratives: DataFrame, capsules: DataFrame,
    scope: int = K.GRAPH_SCOPE, top: int = K.GRAPH_TOP, max_out: int = K.GRAPH_MAX_OUT,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges.  Ranking counts all later commits in scope; only the newest ``max_out`` become edges."""
    rows = graph_scope(commits, narratives, scope)
    reach = _reach(rows, files, scope)
    ranked = top_n(reach, ["project"], [F.col("out_degree").desc(), F.col("ts").desc()], top, "rank")

    def listed(word: int) -> Column:
        places = F.sequence(F.lit(_BITS - 1), F.lit(0))
        hit = lambda i: F.call_function("getbit", F.col(f"m{word}"), i) == 1
        return F.transform(F.filter(places, hit), lambda i: i + word * _BITS)

    newest = F.slice(F.concat(*[listed(w) for w in reversed(range(_words(scope)))]), 1, max_out)
    targets = ranked.select("project", F.col("sha").alias("from_sha"), F.explode(newest).alias("ts"))
    places = rows.select("project", "ts", F.col("sha").alias("to_sha"))
    edges = targets.join(places, ["project", "ts"]).select("project", "from_sha", "to_sha")

    badges = capsule_badges(capsules)
    ids = ranked.select("project", "sha", F.lit(True).alias("is_decision"), "out_degree").unionByName(
        edges.select("project", F.col("to_sha").alias("sha"), F.lit(False).alias("is_decision"),
                     F.lit(None).cast("bigint").alias("out_degree")))
    unique = ids.groupBy("project", "sha").agg(F.max("is_decision").alias("is_decision"), F.max("out_degree").alias("out_degree"))
    decides = F.col("is_decision")
    nodes = unique.join(rows, ["project", "sha"]).join(badges, ["project", "sha"], "left").select(
        "project", "sha", F.date_format("date", "yyyy-MM-dd").alias("day"), redact(F.col("subject")).alias("subject"),
        F.when(decides, redact(F.col("text"))).otherwise("").alias("text"),
        F.when(decides, F.col("kind")).otherwise("change").alias("kind"),
        F.when(decides, F.coalesce("badge", F.lit(""))).otherwise("").alias("badge"),
        "ts", "out_degree",
    )
    return nodes, edges


def capsule_badges(capsules: DataFrame) -> DataFrame:
    """Badge text of a commit: the answers given so far, or "to be checked"."""
    answers = F.array_sort(F.collect_list(F.when(F.col("outcome").isNotNull(), F.struct("capsule_id", redact(F.col("outcome")).alias("o")))))
    return capsules.groupBy("project", "sha").agg(answers.alias("a")).select(
        "project", "sha",
        F.concat(
            F.lit(K.BADGE_PREFIX),
            F.when(F.size("a") > 0, F.array_join(F.transform("a", lambda x: x["o"]), "、")).otherwise(K.BADGE_PENDING),
        ).alias("badge"),
    )


def canvas_nodes(nodes: DataFrame) -> DataFrame:
    """Board layout of the nodes: x by time, y cycling over eight lanes, colour by kind.  A project has at most
    top·(1+max_out) nodes, so numbering them per project is bounded."""
    order = W.partitionBy("project").orderBy("ts")
    label = F.coalesce(F.nullif("text", F.lit("")), F.nullif("subject", F.lit("")), F.substring("sha", 1, 7))
    badge = F.when(F.col("badge") != "", F.concat(F.lit("\n"), F.col("badge"))).otherwise("")
    sha7 = F.substring("sha", 1, 7)
    return nodes.select(
        "project", short_hash(sha7, 16).alias("id"),
        F.concat(F.lit("["), sha7, F.lit("] "), label, badge).alias("text"),
        (F.col("ts") * 450).cast("bigint").alias("x"),
        (((F.row_number().over(order) - 1) % 8) * 140).cast("bigint").alias("y"),
        F.when(F.col("kind") == "breadcrumb", "5").when(F.col("kind") == "narrative", "6").alias("color"),
    )


def canvas_edges(edges: DataFrame) -> DataFrame:
    a, b = F.substring("from_sha", 1, 7), F.substring("to_sha", 1, 7)
    return edges.select(
        "project", short_hash(F.concat(a, b), 16).alias("id"), short_hash(a, 16).alias("from_node"),
        short_hash(b, 16).alias("to_node"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One document per project.  Its size is bounded by the caps of the graph."""
    node = F.struct(
        F.substring("sha", 1, 7).alias("id"), F.col("day").alias("date"), "subject", "text", "kind", "badge", "ts")
    edge = F.struct(F.substring("from_sha", 1, 7).alias("from"), F.substring("to_sha", 1, 7).alias("to"))
    n = nodes.groupBy("project").agg(F.array_sort(
        F.collect_list(node), lambda a, b: F.when(a["ts"] < b["ts"], -1).when(a["ts"] > b["ts"], 1).otherwise(0)).alias("nodes"))
    e = edges.groupBy("project").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return n.join(e, "project", "left").select("project", F.to_json(F.struct("nodes", "edges")).alias("json"))
