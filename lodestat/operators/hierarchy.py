"""Parent-child links to full hierarchies by tree contraction (rake and compress)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestat.sources.tables import materialise, release

#: More rounds than any input of a 64-bit row count needs; reached only through a fault.
MAX_ROUNDS = 400


def uuid_key(ref: Column) -> Column:
    """A UUID reference in its one lower-case hyphenated form, whatever its case, braces,
    hyphens, prefix or surrounding blanks; other non-blank text trimmed; blank is null."""
    text = F.trim(F.regexp_replace(ref, r"(?U)^\s+|\s+$", ""))
    hexed = F.lower(F.regexp_replace(F.regexp_replace(text, r"(?i)^urn:uuid:", ""), r"[{}()\-]", ""))
    uuid = F.regexp_replace(hexed, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(hexed.rlike("^[0-9a-f]{32}$"), uuid).when(text != "", text)


def links(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """Distinct nodes and their parents (``id``, ``parent``; null for roots).

    Null and blank ids are dropped. Of a repeated node the least non-null parent
    counts. A parent that is blank or meets no node makes the node a root.
    """
    nodes = rows.select(uuid_key(F.col(node)).alias("id"), uuid_key(F.col(parent)).alias("ref")).where("id IS NOT NULL")
    nodes = nodes.groupBy("id").agg(F.min("ref").alias("ref"))
    known = nodes.select(F.col("id").alias("parent"))
    return nodes.join(known, nodes["ref"] == known["parent"], "left").select("id", "parent")


def forest(trees: dict[str, DataFrame]) -> DataFrame:
    """Several hierarchies as one, so that they are contracted in the same rounds; ids get the name in front (``part_of``)."""
    named = [t.select(F.concat(F.lit(f"{name}:"), F.col("id")).alias("id"), F.concat(F.lit(f"{name}:"), F.col("parent")).alias("parent")) for name, t in trees.items()]
    return reduce(DataFrame.unionByName, named)


def part_of(column: str) -> tuple[Column, Column]:
    """(name of the hierarchy, id in it) of an id of a ``forest``; an empty id stays empty."""
    return F.split_part(F.col(column), F.lit(":"), F.lit(1)), F.regexp_replace(F.col(column), "^[^:]*:", "")


#: What became of a node in a round.
LIVE, RAKED, SPLICED = 0, 1, 2

#: One round: every leaf is raked into its parent; then unary nodes that are local maxima of the round's hash, so that
#: no two of them are neighbours, are spliced out. The parent of a spliced node stays: a spliced row is as it was.
_ROUND = """
    WITH told AS (
        SELECT parent AS k, sum(IF(kids = 0, acc + 1 + above, 0)) AS add, count_if(kids > 0) AS left, min(IF(kids > 0, struct(id, above), NULL)) AS next
        FROM {live} WHERE parent IS NOT NULL GROUP BY parent),
    kept AS (
        SELECT *, IF(kids = 1 AND parent IS NOT NULL AND parent <> id AND xxhash64(id, {rnd}) > xxhash64(parent, {rnd}) AND xxhash64(id, {rnd}) > xxhash64(kid, {rnd}), 2, 0) AS state
        FROM (SELECT id, parent, w, above, acc + coalesce(add, 0L) AS acc, coalesce(left, 0L) AS kids, next.id AS kid, next.above AS kid_above
              FROM {live} LEFT JOIN told ON id = k WHERE kids > 0 OR parent IS NULL)),
    over AS (SELECT id AS v, parent AS vp, w AS vw, acc + 1 + above AS vabove FROM kept WHERE state = 2)
    SELECT id, coalesce(vp, parent) AS parent, w + coalesce(vw, 0L) AS w, above + coalesce(vabove, 0L) AS above, acc, kids, state, IF(state = 2, kid, NULL) AS kid, IF(state = 2, acc + 1 + kid_above, NULL) AS size
    FROM kept LEFT JOIN over ON coalesce(parent, id) = v  -- a root meets nothing: null keys would all be one task's
    UNION ALL
    SELECT id, parent, w, above, acc, kids, 1, CAST(NULL AS STRING), acc + 1 FROM {live} WHERE kids = 0 AND parent IS NOT NULL"""

#: One doubling: each node looks from the ancestor and the child it has reached to those that they have reached;
#: where there is nothing left to reach, it meets itself, so that null keys are not all one task's.
_FURTHER = """
    SELECT s.id, IF(s.up IS NULL, NULL, a.up) AS up, IF(s.up IS NULL, s.depth, s.depth + a.depth) AS depth, IF(s.up IS NULL, s.root, a.root) AS root,
        IF(s.kid IS NULL, NULL, k.kid) AS kid, IF(s.kid IS NULL, s.size, s.size + k.size) AS size, IF(s.kid IS NULL, s.on_loop, k.on_loop) AS on_loop
    FROM {state} s JOIN {state} a ON coalesce(s.up, s.id) = a.id JOIN {state} k ON coalesce(s.kid, s.id) = k.id"""


def _written(rows: DataFrame, open_rows: Column) -> tuple[DataFrame, int]:
    """``rows`` materialised, and how many of them are open, counted by the same job."""
    seen = Observation()
    return materialise(rows.observe(seen, F.count_if(open_rows).alias("open"))), seen.get["open"]


def contract(tree: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rake leaves and splice unary chains until nothing but roots and loops is left; one job a round.

    Returns the tables of the rounds, in which the nodes removed have their state,
    and the core. A live node carries ``w`` (edges up to its present parent),
    ``above`` (nodes folded into that edge, with all that hung on them) and ``acc``
    (raked descendants).
    """
    first = tree.groupBy("parent").agg(F.count(F.lit(1)).alias("kids")).where("parent IS NOT NULL").withColumnRenamed("parent", "k")
    zero = F.lit(0).cast("long")
    live = tree.join(first, tree["id"] == first["k"], "left").select(
        "id", "parent", F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("w"), zero.alias("above"), zero.alias("acc"), F.coalesce("kids", zero).alias("kids"),
    )
    unfinished = F.col("parent").isNotNull() & (F.col("parent") != F.col("id"))
    live, left = _written(live, unfinished)
    rounds: list[DataFrame] = []
    for rnd in range(MAX_ROUNDS):
        if not left:
            return rounds, live
        done, left = _written(live.sparkSession.sql(_ROUND, live=live, rnd=rnd), (F.col("state") == LIVE) & unfinished)
        rounds.append(done)
        live = done.where(F.col("state") == LIVE).select("id", "parent", "w", "above", "acc", "kids")
    raise RuntimeError(f"tree contraction did not end in {MAX_ROUNDS} rounds")


def hierarchy(tree: DataFrame) -> DataFrame:
    """Root, depth and number of descendants of each node of ``links()``.

    Roots have depth 0. Nodes on a loop have an empty root, depth -1 and
    descendants -1; nodes below a loop have an empty root, depth -2 and their own
    count. Contraction takes a logarithmic number of rounds whatever the depth;
    one hot parent only receives pre-aggregated sums. What can't be contracted is a
    self-loop for each closed loop. The recorded contractions are then reversed: a
    removed node takes root and depth from the parent it had, a spliced one its
    size from the child it had. These records are chains no longer than twice the
    rounds, so following them doubles in reach each time and ends after a few
    joins. An empty table gives an empty result.
    """
    rounds, core = contract(tree)
    loop = F.col("parent").isNotNull()
    none = F.lit(None).cast("string")
    ends = core.select("id", none.alias("up"), F.lit(0).cast("long").alias("depth"), F.when(~loop, F.col("id")).alias("root"), none.alias("kid"), (F.col("acc") + 1).alias("size"), loop.alias("on_loop"))
    gone = [r.where(F.col("state") != LIVE).select("id", F.col("parent").alias("up"), F.col("w").alias("depth"), none.alias("root"), "kid", "size", F.lit(False).alias("on_loop")) for r in rounds]
    pending = F.col("up").isNotNull() | F.col("kid").isNotNull()
    state, left = _written(reduce(DataFrame.unionByName, [ends, *gone]), pending)
    release(*rounds)
    while left:
        before = state
        state, left = _written(state.sparkSession.sql(_FURTHER, state=state), pending)
        release(before)
    lost = F.col("on_loop") | F.col("root").isNull()
    return state.select(
        F.col("id").alias("node_id"), F.when(lost, "").otherwise(F.col("root")).alias("root_id"),
        F.when(F.col("on_loop"), -1).when(lost, -2).otherwise(F.col("depth")).cast("int").alias("depth"), F.when(F.col("on_loop"), -1).otherwise(F.col("size") - 1).cast("int").alias("descendants"),
    )


def paths(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path from the root (``path``, an array that ends in the node) of each node in a tree.

    Paths double in length each round, so depth d takes log2(d) joins. Nodes on or
    below a loop have a null path; those below one have ``below``, the path from the
    first node under the loop. ``nodes`` is the result of ``hierarchy``.
    """
    inside = nodes.where("depth <> -1").select(F.col("node_id").alias("id"))
    state = materialise(tree.join(inside, "id").select("id", F.col("parent").alias("up"), F.array("id").alias("path")))
    while not state.where("up IS NOT NULL").isEmpty():  # a parent on a loop is not in ``state``: the path ends below it
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("above"))
        before, state = state, materialise(
            state.join(above, "up", "left").select("id", F.col("up2").alias("up"), F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", "path")).alias("path"))
        )
        release(before)
    found = nodes.join(state.select(F.col("id").alias("node_id"), F.col("path").alias("line")), "node_id", "left")
    return found.select(*nodes.columns, F.when(F.col("depth") >= 0, F.col("line")).alias("path"), F.when(F.col("depth") < 0, F.col("line")).alias("below"))


def descendants(node_paths: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) rows of the trees and of the subtrees below loops, from ``paths``."""
    lines = node_paths.select(F.col("node_id").alias("descendant_id"), F.coalesce("path", "below").alias("line")).where(F.size("line") > 1)
    return lines.select("descendant_id", (F.size("line") - 1).alias("up"), F.posexplode(F.slice("line", F.lit(1), F.size("line") - 1)).alias("pos", "ancestor_id")).select(
        "ancestor_id", "descendant_id", (F.col("up") - F.col("pos")).cast("int").alias("distance")
    )
