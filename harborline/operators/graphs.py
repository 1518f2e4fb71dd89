"""Property graphs: features, checks, closures and cheapest paths, by iterated joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.operators.relational import renumbered, top_per_key
from harborline.operators.retrieval import normalised
from harborline.sources.scratch import cut


#: Difficulty by name, what a root costs to start from.
DIFFICULTY = {"beginner": 1.0, "intermediate": 2.0, "advanced": 3.0}
ROOT_SHARE = 0.4
LEVELS = ("beginner", "intermediate", "advanced")


def unified_nodes(parts: list[DataFrame], key: str) -> DataFrame:
    """One row for each id over all parts; the first part wins."""
    return _first_of(parts, [key])


def unified_edges(parts: list[DataFrame]) -> DataFrame:
    """One row for each (src, dst, relation) over all parts; the first part wins."""
    return _first_of(parts, ["src", "dst", "relation"])


def _first_of(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    both = None
    for i, p in enumerate(parts):
        marked = p.withColumn("__part", F.lit(i))
        both = marked if both is None else both.unionByName(marked)
    others = [c for c in both.columns if c not in keys]
    first = both.groupBy(*keys).agg(F.min(F.struct("__part", *[c for c in others if c != "__part"])).alias("__f"))
    return first.select(*keys, *[F.col("__f")[c].alias(c) for c in others if c != "__part"])


def graph_summary(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(what, kind, n): nodes by kind, edges by relation, and edges with an end that is no node."""
    ids = nodes.select("id")
    loose = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(
        edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"), allowMissingColumns=True
    )
    count = lambda df, what, c: df.groupBy(F.col(c).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes, "node", kind).unionByName(count(edges, "edge", "relation")).unionByName(count(loose, "loose", "relation"))


def prerequisite_edges(skills: DataFrame, difficulty: dict[str, float] = DIFFICULTY) -> DataFrame:
    """(src, dst, relation, weight) from each known prerequisite to its skill: the cost of learning the skill after it.

    skills: skill, level, difficulty, hours, prerequisites (array).
    """
    hard = F.lit(2.0)
    for name, value in difficulty.items():
        hard = F.when(F.lower("difficulty") == name, value).otherwise(hard)
    cost = 0.30 + 0.08 * F.coalesce("level", F.lit(1)) + 0.10 * hard + F.least(F.coalesce("hours", F.lit(0)) / 160.0, F.lit(0.8))
    each = skills.select(F.explode("prerequisites").alias("src"), F.col("skill").alias("dst"), F.lit("requires").alias("relation"), F.round(cost, 4).alias("weight"))
    return each.join(skills.select(F.col("skill").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "relation", "weight")


def path_starts(edges: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(node, cost) to start from: known nodes at 0, and nodes without a prerequisite at a share of their own cost
    (nodes: node, cost)."""
    roots = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    both = roots.select("node", (ROOT_SHARE * F.col("cost")).alias("cost")).unionByName(known.select("node", F.lit(0.0).alias("cost")))
    return both.groupBy("node").agg(F.min("cost").alias("cost"))


def dag_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, roots, depth, nodes of cycles or behind them, and whether there is none."""
    placed = levels(edges, nodes)
    n = nodes.agg(F.count_distinct("node").alias("nodes"))
    e = edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    p = placed.agg(F.count_if(F.col("level") == 0).alias("roots"), F.max("level").alias("depth"), F.count("*").alias("__placed"))
    one = n.crossJoin(e).crossJoin(p)  # one row each
    return one.withColumn("cyclic", F.col("nodes") - F.col("__placed")).withColumn("acyclic", F.col("cyclic") == 0).drop("__placed")


def topological_order(edges: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """(node, place): prerequisites first; nodes of the same depth by `order` columns and then by node.

    A valid order, the same in every run; one that takes the least of all ready nodes at each step may differ
    from it, but is one node at a time.  Nodes of cycles have no place.
    """
    placed = levels(edges, nodes.select("node")).join(nodes, "node")
    ranked = renumbered(placed, [F.col("level"), *[F.col(c) for c in order], F.col("node")], "", 1)
    return ranked.select("node", F.col("id").cast("long").alias("place"))


def unit_features(parts: list[Column]) -> Column:
    """The numbers over their length, to six places; a vector of no length stays."""
    v = F.array(*[p.cast("double") for p in parts])
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(length), lambda n: F.when(n <= 1e-8, v).otherwise(F.transform(v, lambda x: F.round(x / n, 6))))[0]


def difficulty_of(name: Column, otherwise: float) -> Column:
    known = reduce(lambda c, kv: F.when(F.lower(name) == kv[0], kv[1]).otherwise(c), DIFFICULTY.items(), F.lit(otherwise))
    return F.coalesce(known, F.lit(otherwise))


def skill_features(level: Column, difficulty: Column, hours: Column, hot: Column) -> Column:
    """Level of five, difficulty of three (intermediate, if it is not known), hours of 200, hot."""
    share = F.least(F.coalesce(hours, F.lit(0)) / 200.0, F.lit(1.0))
    return unit_features([F.coalesce(level, F.lit(1)) / 5.0, difficulty_of(difficulty, 2.0) / 3.0, share, F.coalesce(hot, F.lit(False)).cast("double")])


def resource_features(provider: Column, providers: dict[str, float], level: Column, hours: Column, coverage: Column) -> Column:
    """The provider's score (.5 if it is not known), level of three (beginner, if not known), hours of 100, skills covered of five."""
    score = reduce(lambda c, kv: F.when(F.lower(provider) == kv[0], kv[1]).otherwise(c), providers.items(), F.lit(0.5))
    return unit_features([score, difficulty_of(level, 1.0) / 3.0, F.least(F.coalesce(hours, F.lit(0)) / 100.0, F.lit(1.0)), F.least(F.coalesce(coverage, F.lit(1)) / 5.0, F.lit(1.0))])


def job_features(jobs: DataFrame, job: str, needs: DataFrame, skills: DataFrame) -> DataFrame:
    """(job, v): mean and largest weight, share of core skills, mean level of five and mean hours of 200 of a job's skills; zeros
    without any.  needs: job, skill, weight, core; skills: skill, level, hours."""
    rows = needs.join(skills.select("skill", "level", "hours"), "skill", "left")
    g = rows.groupBy(job).agg(
        F.avg("weight").alias("a"), F.max("weight").alias("m"), F.avg(F.col("core").cast("double")).alias("c"), F.avg(F.coalesce("level", F.lit(1))).alias("l"), F.avg(F.coalesce("hours", F.lit(0))).alias("h")
    )
    v = unit_features([F.col("a"), F.col("m"), F.col("c"), F.col("l") / 5.0, F.least(F.col("h") / 200.0, F.lit(1.0))])
    zeros = F.array(*[F.lit(0.0)] * 5)
    return jobs.select(job).join(g.select(job, v.alias("v")), job, "left").select(job, F.coalesce("v", zeros).alias("v"))


def dangling(edges: DataFrame, nodes: DataFrame, end: str, node: str) -> DataFrame:
    return edges.select(F.col(end).alias(node)).distinct().join(nodes.select(node), node, "left_anti")


def closure(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): what each start reaches along (src, dst) in at most depth steps, at its least depth."""
    seen = start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    front = seen
    edges = cut(edges.select("src", "dst"), "edges")
    for d in range(1, depth + 1):
        step = front.join(edges, front.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d))
        front = cut(front, "closure")
        seen = seen.unionByName(front)
    return seen


def cheapest(edges: DataFrame, sources: DataFrame, width: float | None = None, runs: int = 8) -> DataFrame:
    """(node, cost): least cost to each node from any source, relaxed until no cost is lowered.

    edges: src, dst, cost; sources: node, cost.  Nodes whose cost was lowered wait until their bucket is the lowest:
    each round relaxes those within `width` of the least that waits (None: four mean edge costs), so that few nodes
    go on before they are settled.  A round writes the lowered nodes alone, beside those before; every `runs` of these
    tables are merged into one.  A cycle of negative cost is an error.
    """
    edges = cut(edges.groupBy("src", "dst").agg(F.min("cost").alias("c")), "edges")
    mean, n = edges.agg(F.avg("c"), F.count("*")).first()
    width = width if width is not None else max(4 * (mean or 0.0), 1e-9)
    least = lambda tables: reduce(lambda a, b: a.unionByName(b), tables).groupBy("node").agg(F.min("cost").alias("cost"))
    first = cut(sources.groupBy("node").agg(F.min("cost").alias("cost")), "cheapest")
    known, waiting, rounds = [first], first, 0
    most = n + 1  # a path without cycles has no more edges
    while True:
        low, high = waiting.agg(F.min("cost"), F.max("cost")).first()
        if low is None:
            return least(known)
        now, later = waiting.where(F.col("cost") < low + width), waiting.where(F.col("cost") >= low + width)
        offers = now.join(edges, now.node == edges.src).select(F.col("dst").alias("node"), (F.col("cost") + F.col("c")).alias("cost"))
        offers = offers.groupBy("node").agg(F.min("cost").alias("cost"))
        held = least(known).withColumnRenamed("cost", "__known")
        lowered = cut(offers.join(held, "node", "left").where("__known is null or cost < __known").select("node", "cost"), "lowered")
        known.append(lowered)
        if len(known) >= runs:
            known = [cut(least(known), "cheapest")]
        waiting = lowered
        if high >= low + width:
            waiting = cut(later.join(lowered.select("node"), "node", "left_anti").unionByName(lowered), "waiting")
        rounds += 1
        if low < -abs(mean or 0.0) * most or rounds > 2 * most:
            raise ValueError("a cycle of negative cost")


def neighbour_means(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node, v): mean of the in-neighbours' vectors over symmetric edges, dimension by dimension."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    each = both.join(vectors.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.posexplode("v").alias("p", "x"))
    means = each.groupBy("node", "p").agg(F.avg("x").alias("x"))
    return means.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v"))


def neighbour_embedding(edges: DataFrame, vectors: DataFrame, hops: int = 2) -> DataFrame:
    """(node, v): at each hop the vector beside the mean of the neighbours' (zeros without any), then of unit length."""
    now = vectors.select("node", F.transform("v", lambda x: x.cast("double")).alias("v"))
    for _ in range(hops):
        means = neighbour_means(edges, now).withColumnRenamed("v", "__m")
        zeros = F.transform("v", lambda x: F.lit(0.0))
        now = now.join(means, "node", "left").select("node", F.concat("v", F.coalesce("__m", zeros)).alias("v"))
        now = cut(now, "hop")
    return now.select("node", normalised(F.col("v")).alias("v"))


def percentile_of(df: DataFrame, column: str, share: float, few: int = 100_000) -> float | None:
    """The exact percentile, with linear interpolation: the rank is bracketed by approximate percentiles until the
    rows between are few, so that no task gathers all values."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n = values.count()
    if not n:
        return None
    at = share * (n - 1)
    low, high, below, inside = None, None, 0, n
    while inside > few:
        mine = values if low is None else values.where(F.col("x").between(low, high))
        p = (at - below) / inside
        low, high = mine.agg(F.percentile_approx("x", [max(0.0, p - 0.01), min(1.0, p + 0.01)], 1000)).first()[0]
        below, now = values.agg(F.count_if(F.col("x") < low), F.count_if(F.col("x").between(low, high))).first()
        if now == inside or low == high:
            inside = now
            break
        inside = now
    if low is not None and low == high:
        return low
    mine = values if low is None else values.where(F.col("x").between(low, high))
    counts = sorted((r.x, r.n) for r in mine.groupBy("x").agg(F.count("*").alias("n")).collect())  # `few` at most, or one value in many rows
    first, second = int(at), min(int(at) + 1, n - 1)
    found, seen = {}, below
    for x, c in counts:
        for k in (first, second):
            if seen <= k < seen + c:
                found[k] = x
        seen += c
    a, b = found.get(first, counts[-1][0]), found.get(second, values.where(F.col("x") > counts[-1][0]).agg(F.min("x")).first()[0] if second not in found else 0.0)
    return a + (b - a) * (at - first)


def strong_edges(edges: DataFrame, weight: str, share: float, floor: float) -> DataFrame:
    """Edges at or above the percentile of all weights and the floor."""
    least = percentile_of(edges, weight, share)
    return edges.where(F.lit(False)) if least is None else edges.where(F.col(weight) >= max(least, floor))


def non_edges(edges: DataFrame, nodes: DataFrame, tries: int = 4) -> DataFrame:
    """(src, dst): for each edge a pair of its src and a drawn node that is no edge, the first good one of `tries`
    draws.  Draws come from digests of the edge, so every run gives the same; nodes are numbered first."""
    numbered = cut(renumbered(nodes.select("node").distinct(), [F.col("node")], "", 1).select("node", (F.col("id").cast("long") - 1).alias("__k")), "numbered")
    count = numbered.count()
    known = edges.select("src", "dst").distinct()
    if not count:
        return known.where(F.lit(False))
    drawn = known.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    digest = F.conv(F.substring(F.md5(F.concat_ws("-", "src", "dst", "__i")), 1, 15), 16, 10).cast("long")
    drawn = drawn.withColumn("__k", digest % count).join(numbered, "__k").select("src", F.col("dst").alias("__of"), F.col("node").alias("dst"), "__i")
    good = drawn.where("src <> dst").join(known, ["src", "dst"], "left_anti")
    return good.groupBy("src", "__of").agg(F.min_by("dst", "__i").alias("dst")).select("src", "dst").distinct()


def ordered_path(gaps: DataFrame, key: str, missing: str, skills: DataFrame, resources: DataFrame, most: int = 10, n: int = 2, hours: int = 20) -> DataFrame:
    """(key, step, skill, reason, hours, resources) of the first `most` missing skills of each row, in their order.

    skills: skill, prerequisites (array), hours; resources: skill, place, resource.
    """
    steps = gaps.select(key, F.posexplode(F.slice(missing, 1, most)).alias("__p", "skill"))
    top = top_per_key(resources, ["skill"], [F.col("place"), F.col("resource")], n)
    lists = top.groupBy("skill").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "resource"))), lambda x: x["resource"]).alias("resources"))
    before = F.coalesce(F.slice("prerequisites", 1, 2), F.array())
    reason = F.when(F.size(before) > 0, F.concat(F.array_join(before, " > "), F.lit(" > "), F.col("skill").cast("string"))).otherwise("core")
    joined = steps.join(skills, "skill", "left").join(lists, "skill", "left")
    return joined.select(key, (F.col("__p") + 1).alias("step"), "skill", reason.alias("reason"), F.coalesce("hours", F.lit(hours)).alias("hours"), F.coalesce("resources", F.array()).alias("resources"))


def catalog_with_fallback(catalogs: list[DataFrame], n: int = 3) -> DataFrame:
    """(skill, resources, level, catalog): of each skill the first catalog whose list is not empty, cut at n; a level
    that is not known becomes the first one.  catalogs: skill, resources (array), level."""
    both = None
    for i, c in enumerate(catalogs):
        marked = c.where(F.size("resources") > 0).select("skill", F.struct(F.lit(i).alias("catalog"), "resources", "level").alias("x"))
        both = marked if both is None else both.unionByName(marked)
    first = both.groupBy("skill").agg(F.min_by("x", "x.catalog").alias("x")).select("skill", "x.*")
    level = F.when(F.lower("level").isin(*LEVELS), F.lower("level")).otherwise(LEVELS[0])
    return first.select("skill", F.slice("resources", 1, n).alias("resources"), level.alias("level"), "catalog")


def ego_subgraphs(roles: DataFrame, requires: DataFrame, prerequisites: DataFrame, resources: DataFrame, n: int, depth: int, r: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (role, node, kind) and edges (role, src, dst, relation) around each role: its n heaviest skills, their
    prerequisites to `depth`, and the first r resources of each.  Nodes and edges count once.

    roles: role; requires: role, skill, weight; prerequisites: src, dst (src before dst); resources: skill, resource, place.
    """
    top = cut(top_per_key(requires.join(roles, "role", "left_semi"), ["role"], [F.col("weight").desc(), F.col("skill")], n).select("role", "skill"), "ego-top")
    back = prerequisites.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reach = cut(closure(back, top.select(F.col("skill").alias("node")).distinct(), depth), "ego-reach")
    skills = top.join(reach, top.skill == reach.root).select("role", "node").distinct()
    skills = cut(skills, "ego-skills")
    held = top_per_key(resources, ["skill"], [F.col("place"), F.col("resource")], r).join(skills.withColumnRenamed("node", "skill"), "skill")
    held = cut(held.select("role", "skill", "resource"), "ego-resources")
    # an edge belongs to a role if its later end is above the last depth
    upper = top.join(reach.where(F.col("depth") < depth), top.skill == reach.root).select("role", F.col("node").alias("dst")).distinct()
    before = prerequisites.select("src", "dst").distinct().join(upper, "dst").select("role", "src", "dst")
    text = lambda c: F.col(c).cast("string")
    edge = lambda df, a, b, kind: df.select("role", text(a).alias("src"), text(b).alias("dst"), F.lit(kind).alias("relation"))
    edges = edge(top, "role", "skill", "needs").unionByName(edge(before, "src", "dst", "before")).unionByName(edge(held, "skill", "resource", "taught by")).distinct()
    node = lambda df, c, kind: df.select("role", text(c).alias("node"), F.lit(kind).alias("kind"))
    nodes = node(top.select("role").distinct(), "role", "role").unionByName(node(skills, "node", "skill")).unionByName(node(held, "resource", "resource")).distinct()
    return nodes, edges


def path_subgraph(steps: DataFrame, key: str, place: str, skill: str, owned: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, node, tag) and edges (key, src, dst) of each path, its steps chained in order.

    tag: overlap (owned and wanted), missing (wanted), bridge (neither is wanted).  owned, wanted: key, skill.
    """
    w = Window.partitionBy(key).orderBy(place, skill)
    edges = steps.select(key, F.lag(skill).over(w).alias("src"), F.col(skill).alias("dst")).where("src IS NOT NULL")
    mark = lambda df, name: df.select(key, skill).distinct().withColumn(name, F.lit(True))
    nodes = steps.select(key, skill).distinct().join(mark(owned, "__own"), [key, skill], "left").join(mark(wanted, "__want"), [key, skill], "left")
    tag = F.when(F.col("__own") & F.col("__want"), "overlap").when(F.col("__want"), "missing").otherwise("bridge")
    return nodes.select(key, F.col(skill).alias("node"), tag.alias("tag")), edges


def role_skills(roles: DataFrame, role: str, freq: str, required: str, core: str, optional: str, n: int = 30) -> DataFrame:
    """(role, skill, weight, rank): the largest weight of each skill: its share where the role has shares, and else
    1.05 for core, 1 for required and .65 for optional skills; the n heaviest, ties by skill."""
    listed = lambda c, w: F.transform(F.coalesce(c, F.array()), lambda s: F.struct(s.alias("skill"), F.lit(w).alias("weight")))
    shares = F.transform(F.map_entries(freq), lambda e: F.struct(e["key"].alias("skill"), e["value"].cast("double").alias("weight")))
    fallback = F.concat(listed(required, 1.0), listed(core, 1.05), listed(optional, 0.65))
    items = F.when(F.coalesce(F.size(freq), F.lit(0)) > 0, shares).otherwise(fallback)
    best = roles.select(role, F.explode(items).alias("x")).groupBy(role, "x.skill").agg(F.max("x.weight").alias("weight"))
    return top_per_key(best, [role], [F.col("weight").desc(), F.col("skill")], n)


def jumped(steps: DataFrame, nodes: int) -> DataFrame:
    """(node, to, d): steps (node, to, d) followed until they leave the nodes that have one, by doubling; steps that never do,
    on or behind a ring, are left out."""
    now = cut(steps, "jumps")
    for _ in range(max(1, nodes).bit_length() + 1):
        ahead = now.select(F.col("node").alias("__n"), F.col("to").alias("__t"), F.col("d").alias("__d"))
        met = now.join(ahead, now["to"] == F.col("__n"), "left")
        now = cut(met.select("node", F.coalesce("__t", "to").alias("to"), (F.col("d") + F.coalesce("__d", F.lit(0))).alias("d"), F.col("__n").isNotNull().alias("__on")), "jumps")
        if now.where("__on").isEmpty():
            return now.drop("__on")
        now = now.drop("__on")
    return now.join(now.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to", "d")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): longest path from a root; nodes of cycles, and those behind them, have none.

    A node with one predecessor is as far behind the nearest node that has none, or several, as its chain is long:
    chains and trees are followed by doubling, in rounds that grow with the logarithm of their length, and
    contracted to edges of that length, again and again while they are a tenth of what is left.  The rest is peeled,
    a round for each of its layers.
    """
    left = cut(nodes.select("node").distinct(), "nodes")
    rest = cut(edges.select("src", "dst").distinct().withColumn("w", F.lit(1)), "edges")
    hung = []
    while True:
        into = cut(rest.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src"), F.min("w").alias("w")), "into")
        single = into.where("n = 1").select(F.col("dst").alias("node"), F.col("src").alias("to"), F.col("w").alias("d"))
        some, whole = single.count(), left.count()
        if not some or some * 10 < whole:
            break
        placed = cut(jumped(single, some), "placed")
        hung.append(placed)
        # an edge from what never leaves a ring becomes a ring of its own, and blocks its end as that did
        to, away = placed.select(F.col("node").alias("src"), "to", "d"), single.select(F.col("node").alias("src"), F.lit(True).alias("__single"))
        kept = rest.join(single.select(F.col("node").alias("dst")), "dst", "left_anti").join(to, "src", "left").join(away, "src", "left")
        source = F.coalesce("to", F.when(F.col("__single"), F.col("dst")).otherwise(F.col("src")))
        rest = cut(kept.select(source.alias("src"), "dst", (F.col("w") + F.coalesce("d", F.lit(0))).alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w")), "edges")
        left = cut(left.join(single.select("node"), "node", "left_anti"), "nodes")
    out, best = None, None
    while True:
        ready = left.join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
        level = F.lit(0) if best is None else F.coalesce("best", F.lit(0))
        ready = cut((ready if best is None else ready.join(best, "node", "left")).select("node", level.cast("int").alias("level")), "ready")
        out = ready if out is None else out.unionByName(ready)
        left = cut(left.join(ready.select("node"), "node", "left_anti"), "left")
        if left.isEmpty() or ready.isEmpty():
            break
        offers = rest.join(ready.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (F.col("level") + F.col("w")).alias("best"))
        offers = offers if best is None else offers.unionByName(best.join(left, "node", "left_semi"))
        best = cut(offers.groupBy("node").agg(F.max("best").alias("best")), "best")
        rest = cut(rest.join(ready.select(F.col("node").alias("src")), "src", "left_anti"), "rest")
    for placed in reversed(hung):
        behind = placed.join(out.withColumnRenamed("node", "to"), "to").select("node", (F.col("level") + F.col("d")).cast("int").alias("level"))
        out = cut(out.unionByName(behind), "levels")
    return out
