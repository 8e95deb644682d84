"""A Merkle manifest of a dataset whose upper proofs come from a butterfly exchange.

Every row is a leaf.  The leaves of a source, in order of their ids, are cut into aligned blocks of ``FANOUT ** LEVELS``;
a block hashes its own subtree and knows the lower part of all its proofs.  From then on blocks only swap roots: in round
r the blocks of an aligned group of ``FANOUT`` subtrees, each of ``FANOUT ** r`` blocks, meet by threes, one block out of
each subtree, in such a way that every block takes part.  Each block hashes the common ancestor for itself, so what it has
met so far is the upper part of its proof, and nothing is sent down again.  Blocks that would stand beyond the end of a
source take part as relays without a root: what they meet in one round they hand on in the next.  The roots of the sources
are the leaves of one more tree that is made in the same way.

Leaves get their places from a range sort and the counts of its partitions, so neither a large source nor the list of all
sources is gathered in one task; a group that meets holds at most ``FANOUT`` rows.

Cases: a null field is hashed as ``-``; rows with a null id come first in their source and a null source comes first of
all; rows of one source with equal ids stand in the order of their leaves, and equal rows are leaves of their own; an empty
table gives no rows; extra columns are ignored.  The tampering test takes a null id as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whylake.llm.common import if_small, materialise, remainder, table

#: Nodes hashed into one, and the levels of the tree that a block makes by itself.
FANOUT, LEVELS = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """The bytes that stand for a value in its leaf: their number, a colon and the value; ``-`` for null."""
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def run_hash(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def height(n: Column, fanout: int) -> Column:
    """How many levels lie above ``n`` nodes."""
    powers = [fanout**k for k in range(64) if fanout**k < 1 << 62]
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < n))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos`` from 0 in its group ``grp`` and the number ``n`` of nodes in it."""
    # the last key only parts equal rows, which may stand in any order among themselves
    keys = ["grp", *order, "leaf", "tie"]
    ordered = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialise(ordered.withColumn("tie", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy("grp", "part").agg(F.min("tie").alias("first"), F.count(F.lit(1)).alias("own"))
    whole = Window.partitionBy("grp")
    parts = parts.select("grp", "part", "first", (F.sum("own").over(whole.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(whole).alias("n"))
    return rows.join(parts, ["grp", "part"]).withColumn("pos", F.col("before") + F.col("tie") - F.col("first")).drop("part", "tie", "first", "before")


def blocked(nodes: DataFrame, order: list[str], fanout: int, levels: int) -> DataFrame:
    """(grp, block, blocks, members, tree): nodes in aligned blocks, with the levels of each block's own subtree."""
    size = fanout**levels
    rows = placed(nodes, order)
    kept = [c for c in rows.columns if c not in ("grp", "n")]
    blocks = rows.groupBy("grp", "n", F.expr(f"pos div {size}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in kept if c != "pos")))).alias("members"))

    def above(tree: Column) -> Column:
        top = F.element_at(tree, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(top) - 1) / fanout).cast("int"))
        return F.concat(tree, F.array(F.transform(runs, lambda i: run_hash(F.slice(F.element_at(tree, -1), i * fanout + 1, F.lit(fanout))))))

    steps = F.slice(F.array(*(F.lit(k) for k in range(levels))), F.lit(1), F.least(F.lit(levels), height(F.col("n"), fanout)))
    tree = F.aggregate(steps, F.array(F.col("members.leaf")), lambda acc, _: above(acc))
    return materialise(blocks.select("grp", "block", F.expr(f"(n + {size - 1}) div {size}").alias("blocks"), "members", tree.alias("tree")))


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(grp, block, up, root): the siblings that a block meets round by round, and the root of its group."""
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    rounds = next(k for k in range(64) if fanout**k >= most)
    state = blocks.select("grp", "block", "blocks", F.element_at(F.element_at("tree", -1), 1).alias("own"))
    # relays up to the end of the last subtree of the last round in which their group swaps
    span = F.pow(F.lit(float(fanout)), F.greatest(height(F.col("blocks"), fanout) - 1, F.lit(0))).cast("long")
    beyond = state.where("block = 0").withColumn("end", F.ceil(F.col("blocks") / span).cast("long") * span).where("end > blocks")
    relays = beyond.select("grp", F.explode(F.sequence(F.col("blocks"), F.col("end") - 1)).alias("block"), "blocks", F.lit(None).cast("string").alias("own"))
    state = state.union(relays).withColumn("up", F.array().cast("array<struct<left:string,right:string>>"))
    for r in range(rounds):
        span = fanout**r
        swap = Window.partitionBy("grp", F.expr(f"block div {span * fanout}"), F.expr(f"block % {span}"))
        state = state.withColumn("met", F.collect_list(F.when(F.col("own").isNotNull(), F.struct("block", "own"))).over(swap))
        met = F.array_sort("met")
        left = F.array_join(F.transform(F.filter(met, lambda m: m["block"] < F.col("block")), lambda m: m["own"]), "")
        right = F.array_join(F.transform(F.filter(met, lambda m: m["block"] > F.col("block")), lambda m: m["own"]), "")
        more = F.col("blocks") > span
        up = F.when(more, F.concat("up", F.array(F.struct(left.alias("left"), right.alias("right"))))).otherwise(F.col("up"))
        own = F.when(more & (F.size("met") > 0), run_hash(F.transform(met, lambda m: m["own"]))).when(~more, F.col("own"))
        state = state.select("grp", "block", "blocks", own.alias("own"), up.alias("up"))
    return materialise(state.where("block < blocks").select("grp", "block", "up", F.col("own").alias("root")))


def lower(member: Column, tree: Column, fanout: int, levels: int) -> Column:
    """The siblings of a node inside its block, level by level."""
    within = member["pos"] % fanout**levels

    def step(k: Column) -> Column:
        at = F.floor(within / F.pow(F.lit(float(fanout)), k)).cast("int")
        run = at - at % fanout
        nodes = F.get(tree, k)
        return F.struct(F.array_join(F.slice(nodes, run + 1, at - run), "").alias("left"), F.array_join(F.slice(nodes, at + 2, run + fanout - 1 - at), "").alias("right"))

    return F.transform(F.slice(F.array(*(F.lit(k) for k in range(levels))), F.lit(1), F.size(tree) - 1), step)


def unfolded(blocks: DataFrame, fanout: int, levels: int, *extra: str) -> DataFrame:
    """A row for each node of ``blocks`` (with ``up`` and ``extra``): its columns, and ``steps`` from the leaf up."""
    node = F.transform("members", lambda m: F.struct(m.alias("node"), F.concat(lower(m, F.col("tree"), fanout, levels), F.col("up")).alias("steps")))
    return blocks.select("grp", *extra, F.inline(node)).select("grp", *extra, "node.*", "steps")


def proofs(nodes: DataFrame, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Proofs of ``nodes`` (grp, leaf and more): the columns given, with ``steps``, ``subroot`` and ``root``.

    Each group ``grp`` (text, not null) is a tree over its nodes in the order of ``order``; the roots of the groups, in the
    order of ``grp``, are the leaves of the upper tree.  A step holds the hashes left and right of the path in its run.
    """
    blocks = blocked(nodes, order, fanout, levels)
    own = butterfly(blocks, fanout)
    subroots = own.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("leaf"))
    top_blocks = blocked(subroots, ["name"], fanout, levels)
    top = unfolded(top_blocks.join(butterfly(top_blocks, fanout), ["grp", "block"]), fanout, levels, "root")
    top = materialise(top.select(F.col("name").alias("grp"), F.col("leaf").alias("subroot"), "root", F.col("steps").alias("over")))
    known = own.drop("root").join(if_small(top), "grp").select("grp", "block", F.concat("up", "over").alias("up"), "subroot", "root")
    return unfolded(blocks.join(known, ["grp", "block"]), fanout, levels, "subroot", "root")


def fold(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps) of every row."""
    own = docs.select(group_of(F.col(source)).alias("grp"), F.col(doc_id).alias("doc_id"), leaf([F.col(f) for f in fields]).alias("leaf"))
    return proofs(own, ["doc_id"]).select("doc_id", "leaf", "subroot", "root", "steps")


def group_of(source: Column) -> Column:
    """Sources as text that is never null and keeps their order, null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def checked(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its proof, and whether the proof still holds for the row after tampering."""
    values = {f: F.col(f) for f in FIELDS}
    broken = values | {"text": F.regexp_replace("text", "\n", "")}
    again = F.when((remainder("doc_id", 2) == 0) & F.col("text").contains("\n"), leaf([broken[f] for f in FIELDS]))
    own = docs.select(group_of(F.col("source")).alias("grp"), "doc_id", leaf([values[f] for f in FIELDS]).alias("leaf"), again.alias("again"))
    found = proofs(own, ["doc_id"])
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    folded = found.withColumn("folded_root", fold(F.coalesce("again", "leaf"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(table(spark, sf_dir, "documents"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _walk_sql(name: str, tree: str, start: str) -> str:
    """Fold hashes from ``start`` (no, grp, idx, h) up a tree whose levels end where one node is left."""
    return f"""
{name} AS (
  SELECT 0 AS level, no, grp, idx, h, '' AS proof FROM {start}
  UNION ALL
  SELECT w.level + 1, w.no, w.grp, w.idx // 3, sha256(string_agg(CASE WHEN t.idx = w.idx THEN w.h ELSE t.h END, '' ORDER BY t.idx)),
         any_value(w.proof) || coalesce(string_agg(CASE WHEN t.idx = w.idx THEN NULL ELSE t.h END, '' ORDER BY t.idx), '')
  FROM {name} w JOIN {tree} t ON t.level = w.level AND t.grp = w.grp AND t.idx // 3 = w.idx // 3 WHERE t.n > 1
  GROUP BY w.level, w.no, w.grp, w.idx)"""


def _tree_sql(name: str, start: str) -> str:
    return f"""
{name} AS (
  SELECT 0 AS level, grp, idx, h, n FROM {start}
  UNION ALL
  SELECT any_value(level) + 1, grp, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY grp, idx // 3)"""


#: The tree level by level, and every leaf walked up it.  crc32 is worked out bit by bit over the digits of the id.
SQL = f"""
WITH RECURSIVE bytes AS (
  SELECT row_number() OVER () AS no, *, coalesce(CAST(doc_id AS VARCHAR), '') AS written FROM documents),
crc AS (
  SELECT no, 0 AS bit, CAST(4294967295 AS BIGINT) AS c FROM bytes
  UNION ALL
  SELECT r.no, r.bit + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT crc.no, bit, CASE WHEN bit % 8 = 0 THEN xor(c, CAST(ascii(substr(written, bit // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x
        FROM crc JOIN bytes ON bytes.no = crc.no WHERE bit < 8 * length(written)) r),
even AS (SELECT crc.no FROM crc JOIN bytes ON bytes.no = crc.no WHERE bit = 8 * length(written) AND c & 1 = 1),
heads AS (
  SELECT no, doc_id, coalesce('1' || source, '0') AS grp, text, written, {" || ".join(_field_sql(f"CAST({f} AS VARCHAR)") for f in FIELDS if f != "text")} AS head FROM bytes),
leaves AS (
  SELECT no, doc_id, grp, sha256(head || {_field_sql("text")}) AS h,
         sha256(head || CASE WHEN no IN (SELECT no FROM even) THEN {_field_sql("replace(text, chr(10), '')")} ELSE {_field_sql("text")} END) AS used FROM heads),
placed AS (
  SELECT no, doc_id, grp, h, used, row_number() OVER (PARTITION BY grp ORDER BY doc_id ASC NULLS FIRST, h, no) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_tree_sql("lower_tree", "placed")},
subroots AS (SELECT grp AS name, '' AS grp, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
{_tree_sql("upper_tree", "subroots")},
root AS (SELECT h FROM upper_tree WHERE n = 1),
changed AS (SELECT no, grp, idx, used AS h FROM placed),
{_walk_sql("walk", "lower_tree", "changed")},
arrived AS (SELECT no, max(level) AS level FROM walk GROUP BY no),
half AS (SELECT w.no, w.grp AS name, w.h, w.proof FROM walk w JOIN arrived a ON a.no = w.no AND a.level = w.level),
upper_start AS (SELECT half.no, '' AS grp, s.idx, half.h FROM half JOIN subroots s ON s.name = half.name),
{_walk_sql("upper_walk", "upper_tree", "upper_start")},
ended AS (SELECT no, max(level) AS level FROM upper_walk GROUP BY no)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, root.h AS root, sha256(half.proof || u.proof) AS proof_sha256, u.h AS folded_root, u.h = root.h AS verified
FROM placed p JOIN half ON half.no = p.no JOIN subroots s ON s.name = p.grp JOIN ended e ON e.no = p.no
JOIN upper_walk u ON u.no = e.no AND u.level = e.level, root
"""
