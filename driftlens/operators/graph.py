"""Graph operators: frontiers grow by joins, a level a round, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import walk
from .tables import cut, parted, small, steps


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``node`` and least ``depth`` of all that ``roots`` (``node``) reach along ``src`` to ``dst``; cycles end by the visited set."""
    links = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    front = cut(roots.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for depth in steps(max_depth):
        new = front.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
        if depth % 50 == 0:
            seen = cut(seen)
    return seen


def closure_of_flag(parents: DataFrame, flagged: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Classes that are flagged or extend, at any depth, one that is. ``parents``: child, parent; ``flagged``: node.

    A class has one superclass (of several rows the smallest counts), so each
    round doubles how far up a class looks: log2 of the depth in rounds.
    """
    up = parents.where("child <> parent").groupBy("child").agg(F.min("parent").alias("up"))
    marked = flagged.select("node").distinct().withColumn("flag", F.lit(True))
    nodes = up.select(F.col("child").alias("node")).unionByName(up.select(F.col("up").alias("node"))).unionByName(marked.select("node")).distinct()
    state = nodes.join(up.withColumnRenamed("child", "node"), "node", "left").join(marked, "node", "left")
    state = cut(state.withColumn("flag", F.coalesce("flag", F.lit(False))))
    for _ in range(max_rounds):
        above = state.select(F.col("node").alias("up"), F.col("flag").alias("up_flag"), F.col("up").alias("further"))
        after = state.join(above, "up", "left")
        flag = F.col("flag") | F.coalesce("up_flag", F.lit(False))
        # A flagged class has found what it looks for, one that comes back to itself is on a cycle.
        state = cut(after.select("node", flag.alias("flag"), F.when(~flag & ~F.coalesce(F.col("further") == F.col("node"), F.lit(False)), F.col("further")).alias("up")))
        if not state.where("up is not null").limit(1).count():
            break
    return state.where("flag").select("node")


def walk_up(calls: DataFrame, changed: DataFrame, functions: DataFrame, discount: float = 0.9, max_depth: int | None = None) -> DataFrame:
    """Public callers that a private changed function breaks.

    ``calls``: caller, callee; ``changed``: root, confidence (private ones);
    ``functions``: name, is_public. The walk goes up through private callers
    and stops at public ones, which break with the root's confidence times
    ``discount``, once, however far up. Returns root, broken, confidence, depth.
    """
    if max_depth is None and walk.local_folder(calls):
        hits = walk.walk_files(calls, changed, functions)
        return hits.select("root", "broken", (F.col("confidence") * discount).alias("confidence"), "depth")
    # Level by level: where walks have to fail beyond a depth, or workers can't map the shared folder's files.
    up = cut(calls.where("caller <> callee").distinct().join(functions.withColumnRenamed("name", "caller"), "caller"))
    front = cut(changed.select("root", F.col("root").alias("at")))
    seen, found = front, None
    for depth in steps(max_depth):
        step = front.join(up, F.col("at") == F.col("callee")).select("root", F.col("caller").alias("at"), "is_public").distinct()
        step = cut(step.join(seen, ["root", "at"], "left_anti"))
        hits = step.where("is_public").select("root", F.col("at").alias("broken"), F.lit(depth).alias("depth"))
        found = hits if found is None else found.unionByName(hits)
        seen = seen.unionByName(step.select("root", "at"))
        if depth % 50 == 0:
            seen, found = cut(seen), cut(found)
        front = step.where("not is_public").select("root", "at")
        if not front.limit(1).count():
            break
    return found.join(changed.select("root", "confidence"), "root").select("root", "broken", (F.col("confidence") * discount).alias("confidence"), "depth")


def propagate_one_level(changes: DataFrame, renders: DataFrame) -> DataFrame:
    """A component's behaviour changes reach those that render it. ``changes``: component, category; ``renders``: host, component."""
    hosts = parted(renders.where("host <> component").select("host", "component"), "component").distinct()
    # Of distinct rows on both sides no two pairs are equal.
    pairs = changes.select("component", "category").distinct().join(hosts, "component")
    return pairs.select("host", F.col("component").alias("via"), "category")


#: Relationships from the most telling to the least.
RELATIONSHIPS = ("internal", "prop_passed", "direct_child")


def combine_edges(signals: DataFrame) -> DataFrame:
    """Signals of one (family, parent, child) as one edge: either dimension if any has it, the most telling relationship.

    ``signals`` are in order by ``ordinal``: so is the evidence, joined by
    `` + ``, and the last prop name that one gives stands.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in RELATIONSHIPS]), F.col("relationship"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("evidence").isNotNull(), F.struct("ordinal", "evidence"))))
    return signals.groupBy("family", "parent", "child").agg(
        F.bool_or("chp").alias("chp"),
        F.bool_or("pmc").alias("pmc"),
        F.min_by("relationship", rank).alias("relationship"),
        F.array_join(F.transform(ordered, lambda x: x["evidence"]), " + ").alias("evidence"),
        F.max_by("prop_name", F.when(F.col("prop_name").isNotNull(), F.col("ordinal"))).alias("prop_name"),
    )


def drop_two_way(edges: DataFrame) -> DataFrame:
    """Of two edges that point at each other and both bind the child, the weaker one becomes allowed (neither dimension).

    Required is over wrapper, structural and allowed, in that order. Of two
    equals the edge into the child with more binding edges stays, and on a tie
    the one into the later name. An edge from a node to itself is dropped so too.
    """
    chp = edges.where("chp")
    into = chp.groupBy("family", "child").agg(F.count("*").alias("n"))
    back = chp.select("family", F.col("parent").alias("child"), F.col("child").alias("parent"), F.col("pmc").alias("back"))
    out = edges.join(back, ["family", "parent", "child"], "left").join(into, ["family", "child"], "left")
    out = out.join(into.select("family", F.col("child").alias("parent"), F.col("n").alias("m")), ["family", "parent"], "left")
    stronger = F.col("back") & ~F.col("pmc")
    fewer = (F.col("back") == F.col("pmc")) & ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("child") <= F.col("parent"))))
    loses = F.coalesce(F.col("chp") & (stronger | fewer), F.lit(False))
    return out.withColumns({"chp": F.col("chp") & ~loses, "pmc": F.col("pmc") & ~loses}).drop("back", "n", "m")


def collapse_internal(edges: DataFrame, exported: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Edges between exported nodes, paths through internal ones folded to one.

    A hop whose parent must have its child hands on the strength of the next
    hop, any other makes the whole path allowed. Of several ways from one node
    to another the direct edge counts, else the shortest, the strongest of these.
    """
    cols = ["family", "parent", "child", "chp", "pmc"]
    names = cut(exported.select("family", "node").distinct())
    flag = lambda d, side: d.join(names.select("family", F.col("node").alias(side), F.lit(True).alias(f"{side}_out")), ["family", side], "left")
    marked = cut(flag(flag(edges.select(*cols), "parent"), "child"))
    done = marked.where("parent_out and child_out").select(*cols, F.lit(0).alias("hops"))
    front = cut(marked.where("parent_out and child_out is null").select(*cols))
    hops = marked.where("parent_out is null").select("family", F.col("parent").alias("mid"), F.col("child").alias("next"), F.col("chp").alias("c2"), F.col("pmc").alias("p2"), "child_out")
    seen = front.select(*cols)
    for depth in steps(max_depth):
        if not front.limit(1).count():
            break
        step = front.withColumnRenamed("child", "mid").join(hops, ["family", "mid"])
        step = cut(step.select("family", "parent", F.col("next").alias("child"), (F.col("pmc") & F.col("c2")).alias("chp"), (F.col("pmc") & F.col("p2")).alias("pmc"), "child_out").distinct())
        done = done.unionByName(step.where("child_out and parent <> child").select(*cols, F.lit(depth).alias("hops")))
        # A node is passed once for each strength that a path to it may have.
        front = cut(step.where("child_out is null").select(*cols).join(seen, cols, "left_anti"))
        seen = seen.unionByName(front)
        if depth % 50 == 0:
            seen, done = cut(seen), cut(done)
    best = F.max_by(F.struct("chp", "pmc"), F.struct(-F.col("hops"), F.col("pmc"), F.col("chp")))
    return done.groupBy("family", "parent", "child").agg(best.alias("s")).select("family", "parent", "child", "s.chp", "s.pmc")


def two_hop_violations(edges: DataFrame) -> DataFrame:
    """Grandchildren that may not stand directly in the grandparent: parent to middle to child, and no edge parent to child."""
    a = edges.select("family", "parent", F.col("child").alias("middle"))
    b = edges.select("family", F.col("parent").alias("middle"), "child")
    pairs = a.join(b, ["family", "middle"]).where("parent <> child").select("family", "parent", "middle", "child").distinct()
    return pairs.join(edges.select("family", "parent", "child"), ["family", "parent", "child"], "left_anti")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges added, removed or changed in strength between two composition trees."""
    a = old.select("family", "parent", "child", F.struct("chp", "pmc").alias("before"))
    b = new.select("family", "parent", "child", F.struct("chp", "pmc").alias("after"))
    both = a.join(b, ["family", "parent", "child"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "strength")
    return both.withColumn("change", change).where("change is not null").select("family", "parent", "child", "change")


def levels(deps: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Build order: ``node`` and the round in which all it needs (``node`` needs ``dep``) are built; nodes on cycles get none."""
    names = nodes.select("node").distinct()
    needs = deps.where("node <> dep").select("node", "dep").distinct().join(names.withColumnRenamed("node", "dep"), "dep", "left_semi")
    counted = cut(names.join(needs.groupBy("node").agg(F.count("*").alias("n")), "node", "left"))
    edges = cut(needs.join(counted, "node").select("node", "dep", "n"))
    front, done, waiting = counted.where("n is null").select("node"), None, None
    for step in steps(max_depth):
        if not front.limit(1).count():
            break
        level = front.withColumn("level", F.lit(step - 1))
        done = level if done is None else done.unionByName(level)
        # Each need is met once, when what it names is built; a node waits until it has met all its own.
        met = edges.join(small(front.withColumnRenamed("node", "dep")), "dep").groupBy("node", "n").agg(F.count("*").alias("met"))
        if waiting is not None:
            met = met.unionByName(waiting).groupBy("node", "n").agg(F.sum("met").alias("met"))
        met = cut(met)
        front, waiting = met.where("met = n").select("node"), met.where("met < n")
        waiting = waiting if waiting.limit(1).count() else None
        if step % 50 == 0:
            done = cut(done)
    return done if done is not None else names.withColumn("level", F.lit(0))
