"""Graph operators over memory edges (parent_level, parent_id, child_level, child_id, relation[, weight])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable

DRILL = ["contains", "derived_from"]
EDGE = ["parent_level", "parent_id", "child_level", "child_id", "relation"]


def closure(edges: DataFrame, roots: DataFrame, chunks: DataFrame, max_depth: int = 8) -> DataFrame:
    """root_level, root_id, chunk_id: live chunks under each root, over drill-down relations only.

    One frontier join per level for all roots at once. A node is walked once per root, so cycles and
    diamonds end; a frontier is written before it is walked, and the first empty one ends the walk.
    Chunks have nothing below them and are only gathered.
    """
    steps = edges.where(F.col("relation").isin(DRILL)).select(EDGE[:4]).distinct()
    upper, last = steps.where("child_level <> 0"), steps.where("child_level = 0")
    key = ["root_level", "root_id", "level", "id"]
    frontier = roots.select(F.col("level").alias("root_level"), F.col("node_id").alias("root_id"), "level", F.col("node_id").alias("id")).distinct()
    leaves, seen = roots.select(F.col("level").alias("root_level"), F.col("node_id").alias("root_id"), F.col("node_id").alias("id")).where("root_level = 0"), frontier
    for _ in range(max_depth):
        met = (F.col("level") == F.col("parent_level")) & (F.col("id") == F.col("parent_id"))
        leaves = leaves.unionByName(frontier.join(last, met).select("root_level", "root_id", F.col("child_id").alias("id")))
        below = frontier.join(upper, met).select("root_level", "root_id", F.col("child_level").alias("level"), F.col("child_id").alias("id")).distinct()
        frontier = durable(below.join(seen, key, "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return leaves.distinct().withColumnRenamed("id", "chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("root_level", "root_id", "chunk_id")


def children(edges: DataFrame, nodes: DataFrame, relation: str | None = None) -> DataFrame:
    """Edges below ``nodes`` (level, node_id), of one relation where given."""
    return _next_to(edges, nodes, "parent", relation)


def parents(edges: DataFrame, nodes: DataFrame, relation: str | None = None) -> DataFrame:
    """Edges above ``nodes`` (level, node_id), of one relation where given."""
    return _next_to(edges, nodes, "child", relation)


def _next_to(edges: DataFrame, nodes: DataFrame, end: str, relation: str | None) -> DataFrame:
    rows = edges if relation is None else edges.where(F.col("relation") == relation)
    ids = nodes.select(F.col("level").alias(f"{end}_level"), F.col("node_id").alias(f"{end}_id")).distinct()
    return rows.join(ids, [f"{end}_level", f"{end}_id"], "left_semi")


def cooccurrence(membership: DataFrame, group: str, item: str, part: int = 2048) -> DataFrame:
    """a, b (a < b), weight: in how many groups two items meet.

    The pairs of a group of m items are m x m rows of work by definition; a group above ``part`` items is dealt over
    several tasks, and pairs are summed before they are shuffled.
    """
    rows = membership.select(group, item).distinct()
    return _meetings(rows, group, item, part).groupBy("a", "b").agg(F.count("*").alias("weight"))


def cooccurrence_change(membership: DataFrame, group: str, item: str, part: int = 2048) -> DataFrame:
    """a, b (a < b), change: in how many groups more (or less) two items meet than before, where that isn't 0.

    ``membership``: ``group``, ``item``, was, now (0 or 1), a row for each pair of them. Old and new meetings are told apart in one pass over the pairs of a group.
    """
    met = _meetings(membership, group, item, part, "was", "now")
    moved = F.col("now_a") * F.col("now_b") - F.col("was_a") * F.col("was_b")
    return met.select("a", "b", moved.alias("change")).where("change <> 0").groupBy("a", "b").agg(F.sum("change").alias("change")).where("change <> 0")


def _meetings(rows: DataFrame, group: str, item: str, part: int, *more: str) -> DataFrame:
    """a, b (a < b) of all pairs of items in a group, with what else is known of either (``more``, ending in _a and _b)."""
    salts = rows.groupBy(group).agg(F.ceil(F.count("*") / part).cast("int").alias("__salts"))
    sized = rows.join(salts, group)
    of = lambda end: [F.col(c).alias(f"{c}_{end}") for c in more]
    left = sized.select(group, F.col(item).alias("a"), *of("a"), F.pmod(F.xxhash64(item), F.col("__salts")).cast("int").alias("__salt"))
    right = sized.select(group, F.col(item).alias("b"), *of("b"), F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt"))
    return left.join(right, [group, "__salt"]).where("a < b")


def concept_links(edges: DataFrame) -> DataFrame:
    """All edges with those between concepts made anew: two concepts relate by the number of episodes that hold events of both."""
    held = edges.where("relation = 'contains' and child_level = 1")
    # Edges that stand twice fall together in ``cooccurrence``.
    of = lambda level, name: held.where(F.col("parent_level") == level).select(F.col("child_id").alias("event"), F.col("parent_id").alias(name))
    pairs = cooccurrence(of(3, "concept").join(of(2, "episode"), "event"), "episode", "concept")
    fresh = pairs.select(F.lit(3).alias("parent_level"), F.col("a").alias("parent_id"), F.lit(3).alias("child_level"), F.col("b").alias("child_id"), F.lit("relates_to").alias("relation"), F.col("weight").cast("double").alias("weight"))
    return edges.where("relation <> 'relates_to'").unionByName(fresh, allowMissingColumns=True)


def rank_edges(edges: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """a, b, weight of the edges that PageRank walks: containment and relations between nodes of the levels."""
    inside = F.col("parent_level").between(low, high) & F.col("child_level").between(low, high)
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return edges.where(inside & F.col("relation").isin("contains", "relates_to")).select(F.col("parent_id").alias("a"), F.col("child_id").alias("b"), weight.alias("weight"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 50, every: int = 10) -> DataFrame:
    """node_id, centrality: weighted, undirected, dangling mass spread evenly, divided by the largest.

    ``edges``: a, b, weight; parallel edges add up, and an edge to an unknown node counts for neither end.

    A round is linear: rank(t + 1) = even(t) + M rank(t), where M walks the edges and even(t) holds what teleports and what dangling
    nodes spread. As edges lead both ways, a dangling node has none at all and only ever holds even mass, so all even(t) follow from
    the number of such nodes, and the rounds need one join and one sum each. Every
    ``every`` rounds are one job, whose ranks are written to the checkpoint folder.
    """
    ids = nodes.select("node_id").distinct()
    ends = edges.where("weight > 0").join(ids.select(F.col("node_id").alias("a")), "a", "left_semi").join(ids.select(F.col("node_id").alias("b")), "b", "left_semi")
    both = ends.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(ends.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    both = both.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    out = both.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = durable(both.join(out, "src").select("src", "dst", (damping * F.col("weight") / F.col("total")).alias("share")))
    linked = shares.select(F.col("src").alias("node_id")).distinct()
    n, alone = max(ids.count(), 1), ids.join(linked, "node_id", "left_anti")
    n_alone = alone.count()
    # A rank is the sum of even masses, each walked as many rounds as it is old: oldest first here.
    mass = [1.0]
    for _ in range(iterations):
        mass.append((1 - damping) + damping * mass[-1] * n_alone / n)
    rank = linked.withColumn("rank", F.lit(mass[0] / n))
    for k, m in enumerate(mass[1:], 1):
        walked = rank.withColumnRenamed("node_id", "src").join(shares, "src").groupBy(F.col("dst").alias("node_id"))
        rank = walked.agg((F.sum(F.col("rank") * F.col("share")) + m / n).alias("rank"))
        rank = durable(rank) if k % every == 0 else rank
    rank = durable(rank.unionByName(alone.withColumn("rank", F.lit(mass[-1] / n))))
    top = rank.agg(F.max("rank")).first()[0]
    return rank.select("node_id", (F.col("rank") / F.lit(top or 1.0)).alias("centrality"))


def dangling_edges(edges: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with an endpoint that doesn't exist (level 0: chunk_id, else node_id)."""
    live = nodes.select(F.lit(1).alias("kind"), F.col("node_id").alias("id")).unionByName(chunks.select(F.lit(0).alias("kind"), F.col("chunk_id").alias("id")))
    kind = lambda c: F.when(F.col(c) == 0, 0).otherwise(1)
    parents, children = live.toDF("pk", "pid"), live.toDF("ck", "cid")
    no_parent = edges.join(parents, (kind("parent_level") == F.col("pk")) & (F.col("parent_id") == F.col("pid")), "left_anti")
    no_child = edges.join(children, (kind("child_level") == F.col("ck")) & (F.col("child_id") == F.col("cid")), "left_anti")
    return no_parent.unionByName(no_child).distinct()


def supported(edges: DataFrame, chunks: DataFrame, max_depth: int = 8) -> DataFrame:
    """level, node_id of all nodes with a live chunk below them, at most ``max_depth`` edges down.

    One walk upwards from the live chunks, which passes every node once; no pairs of roots and nodes are made.
    """
    steps = edges.where(F.col("relation").isin(DRILL)).select(EDGE[:4]).distinct()
    above = lambda rows: rows.select(F.col("parent_level").alias("level"), F.col("parent_id").alias("node_id")).distinct()
    held = steps.where("child_level = 0").join(chunks.select(F.col("chunk_id").alias("child_id")), "child_id", "left_semi")
    upper = steps.where("child_level <> 0")
    found = frontier = durable(above(held))
    for _ in range(max_depth - 1):
        below = frontier.select(F.col("level").alias("child_level"), F.col("node_id").alias("child_id"))
        frontier = durable(above(upper.join(below, ["child_level", "child_id"], "left_semi")).join(found, ["level", "node_id"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def unsupported_nodes(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes without a live chunk below them."""
    return nodes.join(supported(edges, chunks), ["level", "node_id"], "left_anti").select(nodes.columns)


#: Blocks on a side of the areas in which events' and chunks' blocks meet, and chunks that follow each other below one event.
_AREA, _TURN = 64, 256


def reanchor(edges: DataFrame, events: DataFrame, chunks: DataFrame, part: int = 2048) -> DataFrame:
    """Evidence edges after re-chunking: an event (node_id, source_id) with a dead chunk gets all chunks of its source.

    A source's hurt events times its chunks are edges by definition. They are made last, from squares of about ``part`` events by ``part`` chunks that are dealt over the tasks as
    two arrays each, and go out as they are made: no pair is made twice, and stored edges that would be made again are told by their ends, so the pairs aren't shuffled.
    A task has neighbouring squares, and every event of a square meets the same ``_TURN`` chunks in the same order before the next ones: files in columns then hold few different
    ids and repeat themselves, which takes a small part of the bytes of pairs in any order.
    """
    evidence = F.coalesce((F.col("relation") == "derived_from") & (F.col("child_level") == 0), F.lit(False))
    dead = edges.where(evidence).join(chunks.select(F.col("chunk_id").alias("child_id")), "child_id", "left_anti")
    held = chunks.where("source_id is not null and chunk_id is not null").select("source_id", "chunk_id").distinct()
    homes = events.where("source_id is not null").select("node_id", "source_id").distinct()
    hurt = dead.select(F.col("parent_id").alias("node_id")).distinct().join(homes, "node_id").join(held.select("source_id").distinct(), "source_id", "left_semi")
    hurt = durable(hurt)
    return _kept(edges, evidence, hurt, held, chunks).unionByName(_every_pair(hurt, held, part))


def _kept(edges: DataFrame, evidence, hurt: DataFrame, held: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges without the dead evidence of hurt events and without what they get anew; most are told by their chunk alone and meet no event."""
    whole = evidence & F.col("child_id").isNotNull() & F.col("parent_level").isNotNull()
    sources = held.groupBy(F.col("chunk_id").alias("child_id")).agg(F.collect_list("source_id").alias("__of"))
    live = chunks.where("chunk_id is not null").select(F.col("chunk_id").alias("child_id")).distinct().join(sources, "child_id", "left")
    live = live.withColumn("__of", F.coalesce("__of", F.array().cast(sources.schema["__of"].dataType)))
    told = edges.where(whole).select(EDGE).join(live, "child_id", "left")
    ends = hurt.groupBy(F.col("node_id").alias("parent_id")).agg(F.collect_set("source_id").alias("__in"))
    gone = F.col("__in").isNotNull() & (F.col("__of").isNull() | (F.col("parent_level") == 1) & F.arrays_overlap("__of", "__in"))
    asked = told.where("__of is null or size(__of) > 0").join(ends, "parent_id", "left").where(~gone)
    return edges.where(~whole).select(EDGE).unionByName(told.where("size(__of) = 0").select(EDGE)).unionByName(asked.select(EDGE)).distinct()


def _every_pair(hurt: DataFrame, held: DataFrame, part: int) -> DataFrame:
    """Evidence edges of all events (node_id, source_id) and chunks (source_id, chunk_id) of a source; neither has a row twice."""
    rows, cols = durable(_blocks(hurt, "node_id", "__row", part)), durable(_blocks(held, "chunk_id", "__col", part))
    count = lambda blocks, name: blocks.groupBy("source_id").agg(F.count("*").alias(name))
    sizes = count(rows, "__rows").join(count(cols, "__cols"), "source_id")
    squares = sizes.agg(F.sum(F.col("__rows") * F.col("__cols"))).first()[0] or 0
    # So few bytes make so many rows that their number of partitions must not follow the bytes.
    n = int(hurt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    area = lambda c: F.floor(F.col(c) / _AREA)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), area(c)))
    sizes = sizes.withColumns({c: F.col(c) - 1 for c in ("__rows", "__cols")})
    left = rows.join(sizes, "source_id").select("source_id", "__row", "node_id", area("__row").alias("__down"), every("__cols").alias("__across"))
    right = cols.join(sizes, "source_id").select("source_id", "__col", "chunk_id", area("__col").alias("__across"), every("__rows").alias("__down"))
    met, order = ["source_id", "__down", "__across"], ["source_id", "__col", "__row"]
    dealt = left.repartition(n, *met).join(right.repartition(n, *met), met).repartitionByRange(max(n, -(-squares // 32)), *order).sortWithinPartitions(*order)
    turns = F.transform(F.sequence(F.lit(0), F.floor((F.size("chunk_id") - 1) / _TURN).cast("int")), lambda i: F.slice("chunk_id", i * _TURN + 1, F.lit(_TURN)))
    each = dealt.select("node_id", F.explode(turns).alias("__turn")).select(F.explode("node_id").alias("parent_id"), "__turn")
    # Met with places, as a join is compiled and an explode isn't.
    places = F.broadcast(hurt.sparkSession.range(0, _TURN, 1, 1).select(F.col("id").cast("int").alias("__at")))
    pairs = each.join(places, F.col("__at") < F.size("__turn")).select("parent_id", F.get("__turn", "__at").alias("child_id"))
    return pairs.select(F.lit(1).alias("parent_level"), "parent_id", F.lit(0).alias("child_level"), "child_id", F.lit("derived_from").alias("relation"))


def _blocks(rows: DataFrame, item: str, name: str, part: int) -> DataFrame:
    """source_id, ``name``, ``item``: the items of a source as sorted arrays of about ``part``."""
    sizes = rows.groupBy("source_id").agg(F.ceil(F.count("*") / part).alias("__n"))
    return rows.join(sizes, "source_id").groupBy("source_id", F.pmod(F.xxhash64(item), "__n").alias(name)).agg(F.sort_array(F.collect_list(item)).alias(item))
