"""Trees kept as parent columns: sites and requests.

Ancestors are found by doubling: pairs up to distance d joined with themselves give pairs up to 2d, so a chain of any
depth takes the logarithm of its depth in rounds, each an equi-join whose right side is unique per (node, distance).
Each round is written to the shared folder, which keeps the lineage short and gives the next join true sizes. Nodes on
a cycle or below one are told apart first, by pointer jumping; only their pairs are checked for repeats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.keyed import one_row_per
from fleetlens.functions.values import is_blank
from fleetlens.session import stage


def _edges(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    named = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    return named.where(~is_blank(F.col("parent").cast("string")) & F.col("node").isNotNull())


def _doubled(edges: DataFrame, cyclic: bool) -> DataFrame | None:
    """(node, ancestor, distance) along every chain; on cycles every ancestor once, at its smallest distance.

    Edges that are not known to be `cyclic` may be: the result is None once a node turns out to be above itself.
    """
    start = edges.where(F.col("node") != F.col("parent")) if cyclic else edges
    parts = [stage(start.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "closure")]
    step = 1
    while True:
        if not cyclic and not parts[-1].where("node = ancestor").isEmpty():
            return None
        pairs = reduce(DataFrame.unionByName, parts)
        far = parts[-1].where(F.col("distance") == step).select("node", F.col("ancestor").alias("_mid"))
        upper = pairs.select(F.col("node").alias("_mid"), "ancestor", F.col("distance").alias("_more"))
        more = far.join(upper, "_mid").select("node", "ancestor", (F.lit(step) + F.col("_more")).alias("distance"))
        if cyclic:
            more = more.where(F.col("node") != F.col("ancestor")).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
            more = more.join(pairs.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        more = stage(more, "closure")
        if more.isEmpty():
            return pairs
        parts.append(more)
        step *= 2


def _ancestor_pairs(nodes: DataFrame, node: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """The pairs of all nodes, and the nodes whose chain ends in a cycle."""
    edges = one_row_per(_edges(nodes, node, parent), ["node"], last=False)
    pairs = _doubled(edges, cyclic=False)
    if pairs is not None:  # the usual case: one walk, and it meets no cycle
        return pairs, edges.select("node").limit(0)
    endless = stage(tree_roots(nodes, node, parent).where(~F.col("resolved")).select("node"), "cycles")
    pairs = _doubled(edges.join(endless, "node", "left_anti"), cyclic=False)
    return pairs.unionByName(_doubled(edges.join(endless, "node", "left_semi"), cyclic=True)), endless


def site_closure(sites: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, distance) for every node and each of its ancestors, itself at distance 0 included."""
    own = sites.select(F.col(node).alias("node")).distinct().select(
        "node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")
    )
    return own.unionByName(_ancestor_pairs(sites, node, parent)[0])


def site_paths(sites: DataFrame, node: str, parent: str) -> DataFrame:
    """Per node: the top of its chain, depth, path from the top, and a state.

    state: ok, missing parent (the top is named but not in the table) or cycle (the path ends before it would repeat).
    """
    pairs, endless = _ancestor_pairs(sites, node, parent)
    own = sites.select(F.col(node).alias("node")).distinct()
    chain = pairs.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False).alias("_up"))
    tops = own.join(chain, "node", "left").select(
        "node", F.coalesce(F.col("_up")[0]["ancestor"], "node").alias("top"),
        F.coalesce(F.col("_up")[0]["distance"], F.lit(0)).alias("depth"),
        F.concat(F.coalesce(F.col("_up.ancestor"), F.array()), F.array("node")).alias("path"),
    )
    known = own.select(F.col("node").alias("top"), F.lit(True).alias("_known"))
    cycles = endless.withColumn("_cycle", F.lit(True))
    state = F.when(F.col("_cycle"), "cycle").when(F.col("_known").isNull(), "missing parent").otherwise("ok")
    return tops.join(known, "top", "left").join(cycles, "node", "left").select(
        "node", "top", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"),
        state.alias("state"),
    )


def _pointers(nodes: DataFrame, node: str, parent: str) -> tuple[DataFrame, int]:
    """(node, at) of every node and named parent, `at` NULL at a top; and how many of them have a parent."""
    edges = one_row_per(_edges(nodes, node, parent), ["node"], last=False)
    every = nodes.select(F.col(node).alias("node")).where(F.col("node").isNotNull()).union(edges.select("parent")).distinct()
    return every.join(edges, "node", "left").select("node", F.col("parent").alias("at")), edges.count()


def _ahead(rows: DataFrame) -> DataFrame:
    """`rows` with the pointer of each row's target as `_next`; pointers that have arrived have none."""
    target = rows.where("at is not null").select(F.col("node").alias("at"), F.col("at").alias("_next"))
    return rows.join(target, "at", "left")


def effective_site_config(sites: DataFrame, node: str, parent: str, configs: DataFrame) -> DataFrame:
    """(node, key, value, source, distance): for each config key the nearest ancestor that sets it wins, the site first.

    `configs` has (site, key, value), one row per site and key; sites that are only named as a parent may set keys too,
    and sites of no table are left out. After a round of reach d every site knows, of each key, the nearest setter less
    than d steps above, so it holds at most one row per key and no pairs of sites are made. On a cycle pointers go round
    once.
    """
    rows, n_edges = _pointers(sites, node, parent)
    pointers = stage(rows, "pointers")
    own = configs.withColumnRenamed("site", "node").join(pointers.select("node"), "node", "left_semi")
    won = stage(own.select("node", "key", "value", F.col("node").alias("source"), F.lit(0).alias("distance")), "settings")
    reach = 1
    while reach <= 2 * n_edges:
        above = won.select(
            F.col("node").alias("at"), "key", "value", "source", (F.col("distance") + reach).alias("distance"))
        inherited = pointers.where("at is not null").join(above, "at").select(won.columns)
        both = won.unionByName(inherited).groupBy("node", "key").agg(
            F.min_by(F.struct("value", "source", "distance"), "distance").alias("w"))
        won = stage(both.select("node", "key", "w.value", "w.source", "w.distance"), "settings")
        pointers = stage(_ahead(pointers).select("node", F.col("_next").alias("at")), "pointers")
        if pointers.where("at is not null").isEmpty():
            break
        reach *= 2
    return won


def _subtree_sums(rows: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """(node, n) summed over each node and all below it, from (node, at, n); and the pointers that never arrive.

    After a round of reach d a node has the sum over what is less than d steps below, and a pointer d steps up: it adds
    its sum there. So a round moves one row per node, whatever the depth.
    """
    rows = stage(rows, "sums")
    reach = 1
    while True:
        moving = rows.where("at is not null")
        if reach > 2 * n_edges or moving.isEmpty():
            return rows.select("node", "n"), moving.select("node", "at")
        given = moving.groupBy(F.col("at").alias("node")).agg(F.sum("n").alias("_given"))
        ahead = _ahead(rows.select("node", "at", "n")).select("node", F.col("_next").alias("at"), "n")
        rows = stage(ahead.join(given, "node", "left").select("node", "at", (F.col("n") + F.coalesce("_given", F.lit(0))).alias("n")), "sums")
        reach *= 2


def site_device_count(sites: DataFrame, node: str, parent: str, devices: DataFrame, site: str) -> DataFrame:
    """(site, own, subtree): devices of each site itself and of its whole subtree, parents that are only named included.

    Devices are counted per site first; those of no such site are left out. Every site on a cycle has all others of the
    cycle below it, so it counts what they and their branches hold.
    """
    rows, n_edges = _pointers(sites, node, parent)
    counts = devices.groupBy(F.col(site).alias("node")).agg(F.count(F.lit(1)).alias("_n"))
    start = stage(rows.join(counts, "node", "left").select("node", "at", F.coalesce("_n", F.lit(0)).alias("n")), "sites")
    sums, endless = _subtree_sums(start, n_edges)
    if not endless.isEmpty():
        sums = _with_cycles(start, endless, n_edges)
    own = start.select("node", F.col("n").alias("own"))
    return own.join(sums, "node").select(F.col("node").alias("site"), "own", F.col("n").alias("subtree"))


def _with_cycles(start: DataFrame, endless: DataFrame, n_edges: int) -> DataFrame:
    """Subtree sums where some chains end in a cycle: pointers that went further than there are edges stand on one."""
    on_cycle = stage(endless.select(F.col("at").alias("node")).distinct(), "cycle-nodes")
    # cut above the nodes of cycles, they are tops of trees
    cut = start.join(on_cycle.withColumn("_on", F.lit(True)), "node", "left").select(
        "node", F.when(F.col("_on").isNull(), F.col("at")).alias("at"), "n")
    sums, _ = _subtree_sums(cut, n_edges)
    # the smallest node of a cycle names it
    rows = stage(on_cycle.join(start, "node").select("node", "at", F.col("node").alias("cycle")), "cycles")
    reach = 1
    while reach <= 2 * n_edges:
        target = rows.select(F.col("node").alias("at"), F.col("at").alias("_next"), F.col("cycle").alias("_other"))
        rows = stage(rows.join(target, "at").select("node", F.col("_next").alias("at"), F.least("cycle", "_other").alias("cycle")), "cycles")
        reach *= 2
    named = rows.select("node", "cycle").join(sums, "node")
    whole = named.groupBy("cycle").agg(F.sum("n").alias("_all"))
    around = rows.select("node", "cycle").join(whole, "cycle").select("node", "_all")
    return sums.join(around, "node", "left").select("node", F.coalesce("_all", "n").alias("n"))


def tree_roots(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth, resolved) by pointer jumping; chains that end in a cycle are unresolved.

    Only rows still moving are joined, and a row keeps one pointer, so the work is the table times log(depth). A chain
    has at most as many steps as there are edges: what still moves once pointers reach that far is on a cycle.
    """
    edges = one_row_per(_edges(nodes, node, parent), ["node"], last=False)
    tops = nodes.select(F.col(node).alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    done = [stage(tops.select("node", F.col("node").alias("at"), F.lit(0).alias("depth")), "roots")]
    moving = stage(edges.select("node", F.col("parent").alias("at"), F.lit(1).alias("depth")), "roots")
    reach, edges_in_all = 1, moving.count()
    while reach <= 2 * edges_in_all:
        # A pointer takes over the pointer of its target; it has arrived where the target has, or is not there.
        target = reduce(DataFrame.unionByName, [d.withColumn("_done", F.lit(True)) for d in done]).unionByName(
            moving.withColumn("_done", F.lit(False))
        ).select(F.col("node").alias("at"), F.col("at").alias("_next"), F.col("depth").alias("_more"), "_done")
        moved = stage(moving.join(target, "at", "left").select(
            "node", F.coalesce("_next", "at").alias("at"),
            (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"),
            F.coalesce("_done", F.lit(True)).alias("_arrived"),
        ), "roots")
        done.append(moved.where("_arrived").drop("_arrived"))
        moving = moved.where(~F.col("_arrived")).drop("_arrived")
        if moving.isEmpty():
            break
        reach *= 2
    settled = reduce(DataFrame.unionByName, done).withColumn("resolved", F.lit(True))
    return settled.unionByName(moving.withColumn("resolved", F.lit(False))).select(
        "node", F.when(F.col("resolved"), F.col("at")).alias("root"),
        F.when(F.col("resolved"), F.col("depth")).alias("depth"), "resolved",
    )


def request_tree(requests: DataFrame, node: str, parent: str, pending: str) -> DataFrame:
    """Each request with its root, depth, direct children and how many of those are pending."""
    children = _edges(requests, node, parent).select("node", "parent").where(F.col("node") != F.col("parent")).join(
        requests.select(F.col(node).alias("node"), F.col(pending).alias("_pending")), "node"
    ).groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("_children"), F.count_if(F.col("_pending")).alias("_waiting")
    )
    return tree_roots(requests, node, parent).join(children, "node", "left").select(
        "node", "root", "depth", "resolved",
        F.coalesce("_children", F.lit(0)).alias("children"), F.coalesce("_waiting", F.lit(0)).alias("pending_children"),
    )
