"""Code graphs: building, listing, traversal and ranking over nodes and edges tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions.values import metadata_list
from lodestone.sources.shared import stored, stored_by

ARCHITECTURE = ("module", "class", "struct", "interface")
DISPLAYED = ("function", "class", "method", "interface", "struct", "module")
HIDDEN_EDGES = ("declares",)
LEAST_IMPORTANT, MOST_IMPORTANT, IMPORTANT_SHARE = 10, 500, 0.2


def matching(nodes: DataFrame, view: str | None = None, node_type: str | None = None, language: str | None = None, module: str | None = None, name: str | None = None) -> DataFrame:
    out = nodes
    if view == "architecture":
        out = out.where(F.col("node_type").isin(*ARCHITECTURE))
    if node_type:
        out = out.where(F.col("node_type") == node_type)
    if language:
        out = out.where(F.col("language") == language)
    if module:
        out = out.where(F.col("file_path").startswith(module))
    if name:
        out = out.where(F.lower("name").contains(name.lower()))
    return out


def listed(nodes: DataFrame, limit: int, **filters) -> DataFrame:
    return matching(nodes, **filters).orderBy("file_path", "start_line", "name", "id").limit(limit)


def listing_stats(nodes: DataFrame, limit: int, **filters) -> DataFrame:
    """(total, matched, returned, languages) of a listing; languages are those of all nodes."""
    languages = F.array_sort(F.collect_set("language"))
    matched = matching(nodes, **filters).agg(F.count("*").alias("matched"))
    both = nodes.agg(F.count("*").alias("total"), languages.alias("languages")).join(F.broadcast(matched))  # one row each
    return both.select("total", "matched", F.least("matched", F.lit(limit)).alias("returned"), "languages")


def by_qualified_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("qualified_name") == name)


def displayable(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the kinds that are shown, and the edges between them that are no declarations."""
    shown = nodes.where(F.col("node_type").isin(*DISPLAYED))
    return shown, edges_among(edges.where(~F.col("type").isin(*HIDDEN_EDGES)), shown)


def synthesised(nodes: DataFrame) -> DataFrame:
    """(src, dst, type) of edges that nodes(id, parent_id, callees, metadata, name, qualified_name) hold in themselves:
    a parent declares, callees are called, and the names under ``inherits`` and ``imports`` are looked up like edge targets of
    inheritance. What isn't among the nodes gives no edge."""
    known = nodes.select(F.col("id").alias("dst"))
    declares = nodes.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("declares").alias("type")).join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    calls = nodes.select(F.col("id").alias("src"), F.explode("callees").alias("dst"), F.lit("calls").alias("type")).join(known, "dst", "left_semi")
    named = lambda kind: nodes.select(F.col("id").alias("src"), F.lit(kind).alias("type"), F.explode(metadata_list(F.col("metadata"), kind)).alias("target"))
    told = resolve(named("inherits").union(named("imports")), nodes, by_suffix=("inherits", "imports")).where("dst is not null")
    return declares.select("src", "dst", "type").union(calls.select("src", "dst", "type")).union(told.select("src", "dst", "type")).distinct()


def edges_among(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges whose two ends are both selected."""
    ids = selected.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, callers, callees) of resolved calls, sorted and distinct. A node's neighbours become one row, as asked for, so a
    hub's row is as long as it has neighbours; work on edges where that matters."""
    calls = edges.where("type = 'calls' and dst is not null").select("src", "dst").distinct()
    callees = calls.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("callees"))
    callers = calls.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("callers"))
    empty = F.array().cast(callees.schema["callees"].dataType)
    return callers.join(callees, "id", "full").select("id", F.coalesce("callers", empty).alias("callers"), F.coalesce("callees", empty).alias("callees"))


def dedupe_overloads(nodes: DataFrame, key: str, order: str, signature: str) -> DataFrame:
    """The last node of each key, with the signatures of the earlier ones in order. Each list is made once, for its last node."""
    last = F.max(F.struct(F.col(order).alias("_order"), F.struct(*nodes.columns).alias("_node")))
    every = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(signature).alias("s"))))
    found = nodes.groupBy(F.col(key).alias("_key")).agg(last.alias("_last"), every.alias("_all"))
    earlier = F.filter(F.transform(F.slice("_all", F.lit(1), F.size("_all") - 1), lambda x: x["s"]), lambda s: s.isNotNull())
    return found.select("_last._node.*", earlier.alias("overloads"))


def reparented(nodes: DataFrame) -> DataFrame:
    """Methods get the node whose qualified name is theirs without the last part, else null."""
    owners = nodes.select(F.col("id").alias("owner"), F.col("qualified_name").alias("prefix"))
    prefix = F.when(F.col("qualified_name").contains("."), F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    joined = nodes.withColumn("prefix", F.when(F.col("node_type") == "method", prefix)).join(owners, "prefix", "left")
    return joined.withColumn("parent_id", F.when(F.col("node_type") == "method", F.col("owner")).otherwise(F.col("parent_id"))).drop("owner", "prefix")


def import_candidate(raw: Column, target: Column) -> Column:
    """What a raw call target means under one import (``a.b`` or ``a.b as c``), null if nothing."""
    head, alias = F.trim(F.split_part(target, F.lit(" as "), F.lit(1))), F.trim(F.split_part(target, F.lit(" as "), F.lit(2)))
    local = F.when(target.contains(" as "), alias).otherwise(F.element_at(F.split(target, r"\."), -1))
    dotted = (alias == ".") & target.contains(" as ")
    from_local = F.when(raw == local, head).when(raw.startswith(F.concat(local, F.lit("."))), F.concat(head, F.substring(raw, F.length(local) + 1, F.length(raw))))
    out = F.when(dotted, F.when(~raw.contains("."), F.concat(head, F.lit("."), raw))).when(local != "_", from_local)
    return F.when((target != "") & ~target.endswith(".*"), out)


def canonical_calls(calls: DataFrame, nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """calls(src, raw) with ``target``, by the first rule that fits: ``self.`` of a parent, ``this.``
    of a class (TypeScript, JavaScript), a Go receiver, the only import candidate, the bare name in
    its module, else as it is.

    nodes(id, qualified_name, file_path, language, node_type, parent_id, receiver);
    modules(file_path, module, imports).
    """
    own = nodes.select(F.col("id").alias("src"), "qualified_name", "file_path", "language", "parent_id", "receiver")
    parent = nodes.select(F.col("id").alias("parent_id"), F.col("qualified_name").alias("parent_name"), F.col("node_type").alias("parent_type"))
    full = calls.join(own, "src").join(parent, "parent_id", "left").join(modules, "file_path", "left")
    raw, p = F.col("raw"), F.col("parent_name")
    candidates = F.array_distinct(F.filter(F.transform(F.coalesce("imports", F.array().cast("array<string>")), lambda i: import_candidate(raw, i)), lambda c: c.isNotNull()))
    rest = lambda n: F.substring(raw, F.lit(n), F.length(raw))
    receiver = F.concat(F.col("receiver"), F.lit("."))
    target = (
        F.when(raw.startswith("self.") & p.isNotNull(), F.concat(p, F.lit("."), rest(6)))
        .when(raw.startswith("this.") & F.col("language").isin("typescript", "javascript") & (F.col("parent_type") == "class"), F.concat(p, F.lit("."), rest(6)))
        .when((F.col("language") == "go") & raw.startswith(receiver) & F.col("qualified_name").contains("."), F.concat(F.regexp_replace("qualified_name", r"\.[^.]*$", ""), F.substring(raw, F.length("receiver") + 1, F.length(raw))))
        .when(F.size(candidates) == 1, candidates[0])
        .when(~raw.contains(".") & F.col("module").isNotNull(), F.concat(F.col("module"), F.lit("."), raw))
        .otherwise(raw)
    )
    return full.select("src", "raw", target.alias("target"))


def resolve(edges: DataFrame, nodes: DataFrame, by_suffix: tuple[str, ...] = ("inherits",)) -> DataFrame:
    """edges(src, type, target) with ``dst``: the node of that qualified name; for the types by_suffix also the
    only node whose name, or last name parts, it is. Repeated edges count once.

    The suffix rule is an equality join on every suffix of a qualified name, not a scan of all pairs.
    """
    distinct = edges.select("src", "type", "target").distinct()
    exact = nodes.groupBy(F.col("qualified_name").alias("target")).agg(F.min("id").alias("exact"))
    parts = F.split("qualified_name", r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.array_join(F.slice(parts, k, F.greatest(F.size(parts) - k + 1, F.lit(0))), "."))
    named = nodes.select("id", F.explode(F.array_distinct(F.array_append(suffixes, F.col("name")))).alias("target"))
    only = named.where("target != ''").groupBy("target").agg(F.min("id").alias("only"), F.count("*").alias("n")).where("n = 1").select("target", "only")
    out = distinct.join(exact, "target", "left").join(only, "target", "left")
    return out.select("src", "type", "target", F.coalesce("exact", F.when(F.col("type").isin(*by_suffix), F.col("only"))).alias("dst"))


def reresolved(edges: DataFrame, nodes: DataFrame, affected: DataFrame) -> DataFrame:
    """edges(src, type, target, dst) after a change of nodes: dangling ones whose target is among affected(qualified_name)
    are resolved again; all others stay."""
    names = affected.select(F.col("qualified_name").alias("target")).distinct().withColumn("_again", F.lit(True))
    marked = edges.join(names, "target", "left").withColumn("_again", F.coalesce("_again", F.lit(False)) & F.col("dst").isNull())
    again = resolve(marked.where("_again").select("src", "type", "target"), nodes)
    return marked.where("not _again").select("src", "type", "target", "dst").unionByName(again)


def call_counts(edges: DataFrame) -> DataFrame:
    """(src, resolved, unresolved, unresolved_calls) of each caller: targets without a node, sorted."""
    missing = F.col("dst").isNull()
    calls = edges.where("type = 'calls'").groupBy("src")
    return calls.agg(F.count_if(~missing).alias("resolved"), F.count_if(missing).alias("unresolved"), F.array_sort(F.collect_set(F.when(missing, F.col("target")))).alias("unresolved_calls"))


def neighbourhoods(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, callers, callees, members, parent) of ids(id) that exist; ids in the lists are sorted."""
    wanted = ids.select("id").distinct()
    near = lambda rows, at, other, name: rows.join(wanted.withColumnRenamed("id", at), at, "left_semi").groupBy(F.col(at).alias("id")).agg(F.array_sort(F.collect_set(other)).alias(name))
    calls = edges.where("type = 'calls'")
    out = nodes.join(wanted, "id", "left_semi").select("id", "name", F.col("parent_id").alias("parent"))
    for rows, at, other, name in ((calls, "dst", "src", "callers"), (calls, "src", "dst", "callees"), (nodes.select("parent_id", F.col("id").alias("member")), "parent_id", "member", "members")):
        out = out.join(near(rows, at, other, name), "id", "left")
    none = F.array().cast(f"array<{dict(nodes.dtypes)['id']}>")
    return out.select("id", "name", *(F.coalesce(c, none).alias(c) for c in ("callers", "callees", "members")), "parent")


def seed_neighbours(reached: DataFrame, edges: DataFrame, seed, direction: str = "both") -> DataFrame:
    """(direction, id) of a traversal's nodes, reached(id, distance), that call the seed or that it calls."""
    near = reached.where("distance = 1").select("id")
    callers = edges.where(F.col("dst") == seed).select(F.lit("caller").alias("direction"), F.col("src").alias("id"))
    callees = edges.where(F.col("src") == seed).select(F.lit("callee").alias("direction"), F.col("dst").alias("id"))
    chosen = {"callers": callers, "callees": callees, "both": callers.union(callees)}[direction]
    return chosen.distinct().join(near, "id", "left_semi").select("direction", "id")


def most_important(ranks: DataFrame) -> DataFrame:
    """(id, rank) of the first nodes by rank: a fifth of them, LEAST_IMPORTANT at least and MOST_IMPORTANT at most."""
    n = ranks.count()
    return ranks.orderBy(F.desc("rank"), "id").limit(max(LEAST_IMPORTANT, min(MOST_IMPORTANT, int(IMPORTANT_SHARE * n))))


def neighbours(edges: DataFrame, nodes: DataFrame, id) -> DataFrame:
    """(direction, id, name) of a node's callers and callees."""
    calls = edges.where("type = 'calls'")
    callers = calls.where(F.col("dst") == id).select(F.lit("caller").alias("direction"), F.col("src").alias("id"))
    callees = calls.where(F.col("src") == id).select(F.lit("callee").alias("direction"), F.col("dst").alias("id"))
    return callers.union(callees).distinct().join(nodes.select("id", "name"), "id").select("direction", "id", "name")


#: A source of more links than this is a hub: its links are spread over files instead of lying in one bucket.
HUB_DEGREE = 100_000
BROADCAST_HUBS = 1_000_000  # more of them, though fewer than links / HUB_DEGREE, are joined by a shuffle


class _Links:
    """links(at, ...) laid out for joins with a table that is bucketed by ``id``: those of usual sources are bucketed alike, so that a
    join moves neither side; those of hubs lie anywhere, and the few rows for hubs of the other side go to them."""

    def __init__(self, links: DataFrame, name: str, hub_degree: int | None = None):
        hub_degree = hub_degree or HUB_DEGREE
        links = stored(links, f"{name}-all")
        hubs = links.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > hub_degree).select(F.col("at").alias("hub"))
        self.hubs = stored(hubs, f"{name}-hubs")
        self.n_hubs = self.hubs.count()
        self.some = links.columns
        small = (lambda df: F.broadcast(df)) if self.n_hubs <= BROADCAST_HUBS else (lambda df: df)
        self.small = small
        usual = links.join(small(self.hubs), F.col("at") == F.col("hub"), "left_anti") if self.n_hubs else links
        self.usual = stored_by(usual, f"{name}-links", "at")
        self.of_hubs = stored(links.join(small(self.hubs), F.col("at") == F.col("hub"), "left_semi"), f"{name}-of-hubs") if self.n_hubs else None

    def joined(self, rows: DataFrame) -> DataFrame:
        """Each link with the row of rows(id, ...) that it leaves."""
        own = rows.withColumnRenamed("id", "at")
        out = self.usual.join(own, "at")
        if self.of_hubs is None:
            return out
        few = own.join(self.small(self.hubs), F.col("at") == F.col("hub"), "left_semi")
        return out.unionByName(self.of_hubs.join(self.small(few), "at"))


def bfs(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "callees", max_nodes: int | None = None) -> DataFrame:
    """(id, distance) of nodes within ``depth`` hops of roots(id), first distance kept.

    With max_nodes, hops add nodes in the order of the position of the node that they are found
    from, callers before callees, then id, until so many were found besides the roots. Steps and frontiers are
    bucketed by node, hubs apart (_Links), so a hop moves what it finds once, combined by node, and what was
    found before doesn't move. A frontier is written to the shared folder if another hop follows.
    """
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("id"), F.lit(1).alias("way"))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("id"), F.lit(0).alias("way"))
    steps = _Links({"callees": out, "callers": back, "both": out.union(back)}[direction].distinct().withColumnRenamed("id", "to"), "bfs")
    first = roots.select("id", F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("position")).distinct()
    seen, left = [stored_by(first, "bfs-roots", "id")], max_nodes
    for hop in range(1, depth + 1):
        found = steps.joined(seen[-1].select("id", "position"))
        fresh = found.groupBy(F.col("to").alias("id")).agg(F.min(F.struct("position", "way")).alias("o"))
        for known in seen:
            fresh = fresh.join(known.select("id"), "id", "left_anti")
        if left is None:
            frontier = fresh.select("id", F.lit(hop).cast("long").alias("distance"), F.lit(0).cast("long").alias("position"))
        else:
            kept = fresh.orderBy("o.position", "o.way", "id").limit(left)
            frontier = kept.select("id", F.lit(hop).cast("long").alias("distance"), F.row_number().over(W.orderBy("o.position", "o.way", "id")).cast("long").alias("position"))
        if left is not None or hop < depth:
            frontier = stored_by(frontier, "bfs-frontier", "id")
        seen.append(frontier)
        if left is not None:
            left -= frontier.count()
            if left <= 0:
                break
    out = seen[0]
    for part in seen[1:]:
        out = out.unionByName(part)
    return out.select("id", "distance")


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank): dangling mass spread evenly, loops and edges to unknown nodes ignored, sum 1.

    Links are bucketed by their source and ranks alike, hubs apart (_Links), so a round moves neither; it shuffles what the links
    carry once, combined by target before. Its ranks are written to the shared folder, so plans don't
    grow; their sum, the dangling mass and the movement, the only scalars, are observed on the way. Stops once the ranks move less than ``tolerance`` in all.
    Repeated edges count as often as they occur.
    """
    ids = nodes.select("id").distinct()
    known = edges.where("src != dst").select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    degree = known.groupBy("src").agg(F.count("*").alias("degree"))
    links = _Links(known.join(degree, "src").select(F.col("src").alias("at"), "dst", (F.lit(1.0) / F.col("degree")).alias("share")), "pagerank")
    outs = degree.select(F.col("src").alias("id"), F.lit(False).alias("dangling"))
    ids = stored_by(ids.join(outs, "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")), "pagerank-nodes", "id")
    n, loose = ids.agg(F.count("*"), F.count_if("dangling")).first()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    loose /= n
    ranks, total = ids.select("id", "dangling", F.lit(1.0 / n).alias("rank")), 1.0
    for _ in range(rounds):
        moved = links.joined(ranks.select("id", "rank")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        new = ranks.join(moved, "id", "left").select("id", "dangling", ((1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + loose / n)).alias("rank"), F.col("rank").alias("old"))
        seen = Observation()  # sums of the round, taken while it is written
        new = new.observe(seen, F.sum("rank").alias("total"), F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("loose"), F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved"))
        ranks = stored_by(new.drop("old"), "pagerank-ranks", "id")
        total, loose, moved_by = (seen.get[k] for k in ("total", "loose", "moved"))
        if moved_by < tolerance:
            break
    return ranks.select("id", (F.col("rank") / total).alias("rank"))


def subgraph_members(edges: DataFrame, roots: DataFrame, importance: DataFrame, most: int = 20) -> DataFrame:
    """(root, id, place): the root, then its callers and callees by importance, ``most`` at all."""
    near = roots.select(F.col("id").alias("root")).join(edges.select(F.col("src").alias("root"), F.col("dst").alias("id")).union(edges.select(F.col("dst").alias("root"), F.col("src").alias("id"))).distinct(), "root").where("id != root")
    near = near.join(importance, "id", "left").select("root", "id", F.coalesce("importance", F.lit(0.0)).alias("importance"), F.lit(1).alias("far"))
    every = near.unionByName(roots.select(F.col("id").alias("root"), "id", F.lit(0.0).alias("importance"), F.lit(0).alias("far")))
    place = F.row_number().over(W.partitionBy("root").orderBy("far", F.desc("importance"), "id")).cast("long")
    return every.select("root", "id", place.alias("place")).where(F.col("place") <= most)


def cluster_members(vectors: DataFrame, cluster: str, id: str, vector: str) -> DataFrame:
    """(cluster, size, member): each cluster's member of highest cosine to its centroid."""
    at = vectors.select(cluster, F.posexplode(vector).alias("k", "x")).groupBy(cluster, "k").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    centre = at.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "mean"))), lambda s: s["mean"]).alias("centre"))
    from lodestone.functions.vector import cosine

    scored = vectors.join(centre, cluster).select(cluster, id, F.round(cosine(F.col(vector), F.col("centre")), 9).alias("near"))
    return scored.groupBy(cluster).agg(F.count("*").alias("size"), F.max(F.struct("near", -F.col(id)))["col2"].alias("member")).select(cluster, "size", (-F.col("member")).alias("member"))


def cluster_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, fan_in, containment): distinct outside sources, share of own edges that stay."""
    src, dst = (members.select(F.col("id").alias(x), F.col("cluster").alias(f"c_{x}")) for x in ("src", "dst"))
    both = edges.select("src", "dst").distinct().join(src, "src", "left").join(dst, "dst", "left")
    fan = both.where("c_dst is not null and not (c_src <=> c_dst)").groupBy(F.col("c_dst").alias("cluster")).agg(F.count_distinct("src").alias("fan_in"))
    stay = both.where("c_src is not null").groupBy(F.col("c_src").alias("cluster")).agg(F.avg((F.col("c_src").eqNullSafe(F.col("c_dst"))).cast("double")).alias("containment"))
    out = members.select("cluster").distinct().join(fan, "cluster", "left").join(stay, "cluster", "left")
    return out.select("cluster", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("containment", F.lit(0.0)).alias("containment"))
