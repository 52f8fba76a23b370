"""Chat formatting from reply trees: enumerate root-to-leaf paths, rank them, format the chosen ones.

Paths are found by doubling, on ids only. The table of (node, node above it) is joined with itself, which gives the nodes
two above, then four, and so on: a depth of n takes log2(n) joins, each written to the shared folder. Every leaf
then meets these tables from the farthest to the nearest, and each join doubles what it knows of its path, so a node of a path is one small
row until the paths are put in order. Texts join once, at the end.

Template: every turn is ``### role``, a line break, the text, a line break, ``</turn>`` and a line break.
Inside roles and texts the characters backslash, ``#`` and ``<`` get a backslash before them (a role's line break
becomes backslash n), so no text can hold a marker, and reading back takes exactly these backslashes away.
The loss mask is a list of (start, length) spans in code points: the escaped texts of the assistant.

Defined cases: null texts and roles count as empty; a null tree id is a tree of its own; a node whose
parent is absent is a root; nodes on or below a cycle belong to no path, nor do rows without a node id; of rows with one tree and
node id the one with the smallest parent, then score, gives the link, and each gives its turn; equal scores rank by path ids; repeated
rows are separate turns in ``linear_nodes``, where a null turn comes first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attesta.operators.staging import stage

HEAD, TAIL = "### ", "\n</turn>\n"


def escape(text: Column) -> Column:
    for mark in ("\\", "#", "<"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # an escaped pair is passed over whole, so only a free backslash before n is a line break
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def linear_nodes(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Plain conversations as trees of one path: each row replies to the one before it."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    by = W.partitionBy("tree").orderBy("place", "role", "text")
    named = rows.select(F.col(tree).cast("long").alias("tree"), F.col(order).alias("place"), role.alias("role"), text.alias("text"))
    numbered = named.withColumn("node", F.row_number().over(by).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                           "role", "text", F.lit(0.0).alias("score"))


def ranked_paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths: tree, path (node ids), score (sum), branch_rank (1 is best)."""
    one = F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")
    links = stage(nodes.filter("node IS NOT NULL").groupBy("tree", "node").agg(one).select("tree", "node", "m.*"), "links")
    same_tree = F.col("a.tree").eqNullSafe(F.col("b.tree"))
    above = links.select("tree", "node").alias("b")
    jump = stage(links.filter("parent IS NOT NULL").alias("a")
                 .join(above, same_tree & (F.col("a.parent") == F.col("b.node")), "left_semi")
                 .select("tree", "node", F.col("parent").alias("above")), "jump")
    parents = jump.select("tree", F.col("above").alias("node")).distinct()
    largest = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, width = [], 1
    while not jump.isEmpty() and width < largest:  # who still has a node this far above in so small a tree is on or below a cycle
        jumps.append(jump)
        jump = stage(jump.alias("a").join(jump.alias("b"), same_tree & (F.col("a.above") == F.col("b.node")))
                     .select("a.tree", "a.node", "b.above"), "jump")
        width *= 2
    leaves = links.select("tree", "node").alias("a").join(parents.alias("b"), same_tree & (F.col("a.node") == F.col("b.node")), "left_anti")
    met = leaves.alias("a").join(jump.alias("b"), same_tree & (F.col("a.node") == F.col("b.node")), "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for level in reversed(range(len(jumps))):
        both = F.explode(F.array(F.struct("a.node", "a.up"), F.struct(F.col("b.above").alias("node"), (F.col("a.up") + (1 << level)).alias("up"))))
        met = (met.alias("a").join(jumps[level].alias("b"), same_tree & (F.col("a.node") == F.col("b.node")), "left")
               .select("a.tree", "a.leaf", both.alias("s")).filter("s.node IS NOT NULL").select("tree", "leaf", "s.node", "s.up"))
    scored = met.alias("a").join(links.select("tree", "node", "score").alias("b"), same_tree & (F.col("a.node") == F.col("b.node")))
    steps = F.array_sort(F.collect_list(F.struct((-F.col("a.up")).alias("place"), "a.node", "b.score"))).alias("steps")
    paths = scored.groupBy("a.tree", "a.leaf").agg(steps).select(
        "tree", F.transform("steps", lambda x: x["node"]).alias("path"),
        F.aggregate("steps", F.lit(0.0), lambda total, x: total + x["score"]).alias("score"))
    best = W.partitionBy("tree").orderBy(F.desc("score"), "path")
    return paths.withColumn("branch_rank", F.row_number().over(best))


def format_paths(nodes: DataFrame, paths: DataFrame, per_tree: int = 1) -> DataFrame:
    """The best ``per_tree`` paths of each tree as one string each, with the spans the loss is taken on."""
    chosen = paths.filter(F.col("branch_rank") <= per_tree).select(
        F.col("tree").alias("p_tree"), "branch_rank", F.posexplode("path").alias("pos", "p_node"))
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turns = (
        nodes.join(chosen, F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("node") == F.col("p_node")))
        .select("tree", "branch_rank", "pos", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("loss"))
        .withColumns({"h": F.length("head"), "b": F.length("body")})
    )
    before = W.partitionBy("tree", "branch_rank").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    size = F.col("h") + F.col("b") + len(TAIL)
    placed = turns.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.col("h"))
    listed = placed.groupBy("tree", "branch_rank").agg(F.array_sort(F.collect_list(F.struct(
        "pos", F.concat("head", "body", F.lit(TAIL)).alias("piece"), F.col("start").cast("int").alias("start"), "b", "loss"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["b"].alias("length")))
    return listed.select(
        "tree", "branch_rank", F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of struct(role, text)."""
    parts = F.split(formatted, TAIL)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def turn(t: Column) -> Column:
        role = F.substring_index(F.substr(t, F.lit(len(HEAD) + 1)), "\n", 1)
        text = F.substr(t, F.length(role) + len(HEAD) + 2)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))
    return F.transform(turns, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
