"""Graph features, components, co-spending and co-mention operators over edge tables.

Edges with a null end are no edges.  Repeated edges count once.  An empty edge table gives isolated nodes only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window as W

from ledgerweave.plans.skew import HOT, hot_keys, maybe_among, skew_join
from ledgerweave.plans.staging import Stage

#: Open edges of a capped union that one task replays.
REPLAY_ROWS = 200_000


def clean_edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, in_degree, out_degree, total_degree, ratio): one aggregation over both ends; nodes without edges get 0."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    d = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return d.select("node", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"), ((F.col("in_degree") + 1) / (F.col("out_degree") + 1)).alias("ratio"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 200, tolerance: float | None = 1e-6) -> DataFrame:
    """(node, rank): uniform teleport, the mass of dead ends spread evenly; stops when the L1 change is below n * tolerance.

    Not to be there after ``rounds`` rounds is an error; without a tolerance, just so many rounds are made.  Ranks are sent
    along the edges of a sender with very many by broadcast, and summed map-side before they are shuffled.
    """
    stage = Stage(edges.sparkSession)
    out = stage.write(edges.groupBy("src").agg(F.count(F.lit(1)).alias("k")))
    total = out.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    hot = [r[0] for r in out.filter(F.col("k") >= max(1000.0, HOT * total)).select("src").collect()]
    links = stage.write(skew_join(edges, out, "src", hot))
    nodes = stage.write(nodes_of(edges))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    dead = nodes.join(out.select(F.col("src").alias("node"), F.lit(False).alias("dead")), "node", "left")
    rank = stage.write(dead.select("node", F.coalesce("dead", F.lit(True)).alias("dead"), F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("dead"), F.col("rank"))), F.lit(0.0))).first()[0]
        sent = skew_join(links, rank.select(F.col("node").alias("src"), "rank"), "src", hot).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
        new = rank.join(sent, "node", "left").select("node", "dead", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"), F.col("rank").alias("old"))
        new = stage.write(new)
        done = tolerance is not None and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * tolerance
        stage.drop(rank)
        rank = new.select("node", "dead", "rank")
        rank.staged_at = new.staged_at
        if done:
            break
    else:
        if tolerance is not None:
            raise RuntimeError(f"PageRank did not settle in {rounds} rounds")
    stage.drop(out, links, nodes)
    return rank.select("node", "rank")


def components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """(node, component): smallest node of each connected component, by alternating large-star and small-star steps.

    Not to have settled after ``max_rounds`` is an error.
    """
    stage = Stage(edges.sparkSession)
    start = edges.filter("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = stage.write(start)
    state = _fingerprint(e)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        sizes = stage.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("k")))
        hot = [r[0] for r in sizes.filter(F.col("k") >= F.greatest(F.lit(1000.0), F.lit(HOT * max(1, state[0])))).select("u").collect()]
        x = skew_join(both, sizes.select("u", "m"), "u", hot)
        if large:
            new = x.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            new = x.select(F.inline(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m")))).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = stage.write(new.filter("u != v").distinct())
        stage.drop(sizes)
        return out

    for _ in range(max_rounds):
        half = star(e, True)
        new = star(half, False)
        stage.drop(half, e)
        e = new
        before, state = state, _fingerprint(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    every = nodes_of(edges) if nodes is None else nodes_of(edges).unionByName(nodes.select("node")).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(hash(v, u))")).first())


def cospend_edges(tx: DataFrame, tx_id: str, pos: str, addr: str, flags: list[str]) -> DataFrame:
    """Star edges from the first input address of each unflagged transaction to its others."""
    ok = F.lit(True)
    for f in flags:
        ok = ok & ~F.coalesce(F.col(f), F.lit(False))
    # names of its own: columns of the table may be called src or dst
    x = tx.filter(ok & F.col(addr).isNotNull()).select(F.col(tx_id).alias("__t"), F.col(pos).alias("__p"), F.col(addr).alias("dst"))
    first = x.groupBy("__t").agg(F.min_by("dst", "__p").alias("src"))
    return x.join(first, "__t").select("src", "dst").distinct()


def cluster_cospend(tx: DataFrame, tx_id: str, pos: str, addr: str, flags: list[str]) -> DataFrame:
    """(node, component): addresses spent together; addresses of flagged transactions are there alone at least."""
    return components(cospend_edges(tx, tx_id, pos, addr, flags), tx.select(F.col(addr).alias("node")).filter("node is not null").distinct())


def capped_union(edges: DataFrame, order: list[str], cap: int, replay_rows: int = REPLAY_ROWS) -> DataFrame:
    """(node, cluster): unions in the given order, refused where the merged cluster would be larger than ``cap``.

    Clusters only grow, so an edge that is the first open one of both its clusters can be joined at once, whatever comes
    later, and an edge refused once is refused for good.  Rounds of this run on the whole table, giant components too; the
    first open edge of all is decided in each, so they end.  Once at most ``replay_rows`` edges are open, one task replays them.
    """
    stage = Stage(edges.sparkSession)
    edges = edges.filter("src is not null and dst is not null")
    clusters = stage.write(nodes_of(edges).select("node", F.col("node").alias("cluster")))
    rank = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("src"), F.col("dst"))
    x = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("sa"), F.lit(1).cast("long").alias("sb"), rank.alias("rank"))

    def open_edges(x: DataFrame) -> DataFrame:
        """The first edge of each two clusters that may still be joined."""
        x = x.filter((F.col("a") != F.col("b")) & (F.col("sa") + F.col("sb") <= cap))
        swap = F.col("a") > F.col("b")
        low, high = F.struct(F.col("a").alias("c"), F.col("sa").alias("s")), F.struct(F.col("b").alias("c"), F.col("sb").alias("s"))
        x = x.select(F.when(swap, high).otherwise(low).alias("l"), F.when(swap, low).otherwise(high).alias("h"), "rank")
        x = x.groupBy("l", "h").agg(F.min("rank").alias("rank"))
        return stage.write(x.select(F.col("l.c").alias("a"), F.col("h.c").alias("b"), F.col("l.s").alias("sa"), F.col("h.s").alias("sb"), "rank"))

    live = open_edges(x)
    while (n := live.count()) > replay_rows:
        ends = live.select(F.explode(F.array("a", "b")).alias("c"), F.struct("rank", "a", "b", "sa", "sb").alias("e"))
        first = ends.groupBy("c").agg(F.min("e").alias("e"), F.count(F.lit(1)).alias("k"))
        first = stage.write(first)
        hot = [r[0] for r in first.filter(F.col("k") >= max(1000.0, HOT * n)).select("c").collect()]
        joined = first.groupBy("e").agg(F.count(F.lit(1)).alias("k")).filter("k = 2")
        moved = stage.write(joined.select(F.explode(F.array("e.a", "e.b")).alias("c"), F.col("e.a").alias("to"), (F.col("e.sa") + F.col("e.sb")).alias("size")))
        # every cluster with an open edge has a row: itself, or what it was joined to
        now = stage.write(first.select("c").join(moved, "c", "left"))
        for c in ("a", "b"):
            live = skew_join(live, now.withColumnRenamed("c", c), c, hot)
            live = live.select(*[F.coalesce(F.col("to" if k == c else "size"), F.col(k)).alias(k) if k in (c, f"s{c}") else k for k in ("a", "b", "sa", "sb", "rank")])
        live = open_edges(live)
        clusters = stage.write(_moved(clusters, moved))
    kind = clusters.schema["cluster"]
    schema = T.StructType([T.StructField("c", kind.dataType), T.StructField("to", kind.dataType)])

    def run(pdf):
        import pandas as pd

        parent: dict = {}
        size: dict = {}
        low: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b, sa, sb in pdf.sort_values("at")[["a", "b", "sa", "sb"]].itertuples(index=False):
            for x, k in ((a, sa), (b, sb)):
                if x not in parent:
                    parent[x], size[x], low[x] = x, k, x
            a, b = find(a), find(b)
            if a != b and size[a] + size[b] <= cap:
                a, b = (a, b) if size[a] >= size[b] else (b, a)
                parent[b] = a
                size[a] += size[b]
                low[a] = min(low[a], low[b])
        return pd.DataFrame({"c": list(parent), "to": [low[find(x)] for x in parent]})

    # at most replay_rows rows, so one task numbers them
    rest = live.withColumn("at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("rank"))).select("a", "b", "sa", "sb", "at", F.lit(0).alias("task"))
    return _moved(clusters, rest.groupBy("task").applyInPandas(run, schema))


def _moved(clusters: DataFrame, moved: DataFrame) -> DataFrame:
    return clusters.join(moved.select(F.col("c").alias("cluster"), "to"), "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster"))


def comention(mentions: DataFrame, article: str, entity: str, salts: int = 32) -> DataFrame:
    """(a, b, weight), a < b: entities named in one article, weight the number of articles.

    An article with very many entities is cut into ``salts`` parts on one side, each of which meets a copy of the other.
    """
    m = mentions.select(F.col(article).alias("x"), F.col(entity).alias("e")).filter("x is not null and e is not null").distinct()
    m = Stage(m.sparkSession).write(m)
    hot = F.col("x").isin(hot_keys(m, "x"))
    left = m.withColumn("s", F.when(hot, F.pmod(F.xxhash64("e"), F.lit(salts)).cast("int")).otherwise(0))
    right = m.withColumn("s", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).withColumnRenamed("e", "f")
    return left.join(right, ["x", "s"]).filter("e < f").groupBy(F.col("e").alias("a"), F.col("f").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def mention_features(mentions: DataFrame, article: str, entity: str) -> DataFrame:
    """(entity, n_mentions, n_articles, mean_co): mentions, articles, and the mean number of other entities per article, to 4 places."""
    per = mentions.groupBy(article).agg(F.countDistinct(entity).alias("k"))
    each = mentions.groupBy(article, entity).agg(F.count(F.lit(1)).alias("c")).join(per, article)
    return each.groupBy(F.col(entity).alias("entity")).agg(F.sum("c").alias("n_mentions"), F.count(F.lit(1)).alias("n_articles"), F.round(F.avg(F.col("k") - 1), 4).alias("mean_co"))


def hops_from(edges: DataFrame, start, limit: int | None = None, bound: int = 10_000) -> DataFrame:
    """(node, hops): breadth-first distances from a node over undirected edges, the frontier joined round by round until it is empty.

    Only a given ``limit`` leaves farther nodes out; without one, a path longer than ``bound`` is an error.
    """
    stage = Stage(edges.sparkSession)
    both = stage.write(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    hot = hot_keys(both, "src")
    links = both.withColumnRenamed("src", "node")
    last = stage.write(both.filter(F.col("src") == F.lit(start)).select(F.col("src").alias("node")).distinct().withColumn("hops", F.lit(0)))
    levels, before = [last.staged_at], last.limit(0)
    while limit is None or len(levels) <= limit:
        # a neighbour of one level is in it, the one before or the next
        new = skew_join(links, last, "node", hot).select(F.col("dst").alias("node")).distinct().join(last.unionByName(before), "node", "left_anti")
        new = stage.write(new.withColumn("hops", F.lit(len(levels))))
        if new.isEmpty():
            break
        if len(levels) > bound:
            raise RuntimeError(f"nodes more than {bound} hops away")
        levels.append(new.staged_at)
        before, last = last, new
    return edges.sparkSession.read.schema(last.schema).parquet(*levels)


def account_graph(tx: DataFrame, tx_id: str, pos: str, addr: str, flags: list[str]) -> DataFrame:
    """(edge_type, src, dst): co-spending in both directions, and incidence of addresses and transactions both ways."""
    s = cospend_edges(tx, tx_id, pos, addr, flags).filter("src != dst")
    c = F.lit("co_spend")
    co = s.select(c.alias("edge_type"), F.col("src").cast("string"), F.col("dst").cast("string")).unionByName(s.select(c.alias("edge_type"), F.col("dst").cast("string").alias("src"), F.col("src").cast("string").alias("dst")))
    i = tx.filter(F.col(addr).isNotNull()).select(F.col(addr).cast("string").alias("src"), F.col(tx_id).cast("string").alias("dst")).distinct()
    return co.unionByName(i.select(F.lit("addr_tx").alias("edge_type"), "src", "dst")).unionByName(i.select(F.lit("tx_addr").alias("edge_type"), F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def sampled_neighbours(edges: DataFrame, fanout: int, seed: int = 72) -> DataFrame:
    """At most ``fanout`` in-edges per node, chosen by a hash of the edge: the same in every run.

    The plan limits each node's edges in every task before they are shuffled, so a node with very many costs no more than others.
    """
    w = W.partitionBy("dst").orderBy(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("src").cast("string"), F.col("dst").cast("string"))), "src")
    return edges.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= fanout).drop("__r")


def _rounded(v: Column, kind: str, most: int) -> Column:
    """Vector as whole numbers of up to ``most`` times a scale of its own, and a bound of the length of what rounding took away."""
    scale = F.greatest(F.array_max(F.transform(v, F.abs)) / most, F.lit(1e-300))
    x = F.transform(F.array(F.struct(v.alias("x"), scale.alias("s"))), lambda t: F.struct(F.transform(t["x"], lambda p: F.rint(p / t["s"]).try_cast(kind)).alias("v"), t["s"].alias("s"), t["x"].alias("x")))
    left = lambda t: F.sqrt(F.aggregate(F.zip_with(t["x"], t["v"], lambda p, c: (p - c * t["s"]) * (p - c * t["s"])), F.lit(0.0), lambda a, d: a + d))
    # the last term is more than what sums in doubles are off
    return F.get(F.transform(x, lambda t: F.struct(t["v"].alias("v"), t["s"].alias("s"), (left(t) + 1e-9 * most * t["s"] * F.sqrt(F.size(t["x"]))).alias("r"))), F.lit(0))


def _whole(v: Column) -> Column:
    return F.struct(v.alias("v"), F.lit(1.0).alias("s"), F.lit(0.0).alias("r"))


#: Forms of a vector, from the shortest to the vector itself; a later one is read only for pairs that those before leave open.
FORMS = (lambda v: _rounded(v, "byte", 127), lambda v: _rounded(v, "short", 32_767), _whole)


def _apart(links: DataFrame, vectors: DataFrame) -> DataFrame:
    """(u, w, d, ru, rw): distances of linked nodes that both have a row in ``vectors`` (k, x: v, s, r)."""
    side = lambda c: vectors.select(F.col("k").alias(c), F.col("x").alias(f"x{c}"))
    j = skew_join(skew_join(links, side("u"), "u", hot_keys(links, "u")), side("w"), "w", hot_keys(links, "w"))
    gap = F.zip_with("xu.v", "xw.v", lambda p, q: (p * F.col("xu.s") - q * F.col("xw.s")) * (p * F.col("xu.s") - q * F.col("xw.s")))
    return j.select("u", "w", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, d: a + d)).alias("d"), F.col("xu.r").alias("ru"), F.col("xw.r").alias("rw"))


def explained_pairs(pairs: DataFrame, edges: DataFrame, hubs: DataFrame, vectors: DataFrame, key: str, vec: str, eps: float, version: str | None = None) -> DataFrame:
    """(src, dst, confounded, explained, passed) for pairs of nodes with vectors, whose distance a common cause may explain.

    A pair is confounded if both ends neighbour a hub (``hubs``: node); it is explained if the smallest hub next to ``src``
    is, within ``eps``, as far from ``dst`` as ``src`` is.  A pair passes unless it is both.  A hub without a vector explains nothing.
    Of the rows of a key that with the highest ``version`` counts.

    Only vectors of confounded pairs are moved, rounded to 8 bits.  The error of a distance is bounded by what rounding took
    from its ends; pairs that it could decide are taken again with 16 bits, and what is open then from the vectors themselves.
    """
    stage = Stage(edges.sparkSession)
    near = edges.select(F.col("src").alias("x"), F.col("dst").alias("h")).unionByName(edges.select(F.col("dst").alias("x"), F.col("src").alias("h")))
    hubs = stage.write(hubs.select(F.col("node").alias("h")))
    hub = stage.write(maybe_among(near, "h", hubs, hubs.count()).join(hubs, "h", "left_semi").groupBy("x").agg(F.min("h").alias("hub")))
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"), (F.struct(version) if version else F.lit(0)).alias("o"))
    held = stage.write(rows.select("k").distinct())
    both = stage.write(pairs.select("src", "dst"))
    hot = {c: hot_keys(both, c) for c in ("src", "dst")}
    x = skew_join(skew_join(both, held.toDF("src"), "src", hot["src"]), held.toDF("dst"), "dst", hot["dst"])
    x = skew_join(x, hub.toDF("src", "hub"), "src", hot["src"], "left")
    x = skew_join(x, hub.select(F.col("x").alias("dst"), F.lit(True).alias("too")), "dst", hot["dst"], "left")
    x = stage.write(x.select("src", "dst", F.when(F.col("too"), F.col("hub")).alias("hub")))
    stage.drop(both, held, hub, hubs)

    def measured(pairs: DataFrame, form: Callable[[Column], Column]) -> DataFrame:
        """``pairs`` whose hub has a vector, with both distances and the bound of their errors."""
        links = stage.write(pairs.select(F.inline(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("w")), F.struct(F.col("hub").alias("u"), F.col("dst").alias("w"))))).distinct())
        wanted = stage.write(nodes_of(links.select(F.col("u").alias("src"), F.col("w").alias("dst"))))
        v = maybe_among(rows, "k", wanted, wanted.count()).groupBy("k").agg(F.max_by(form(F.col("v")), "o").alias("x"))
        v = stage.write(v)
        d = stage.write(_apart(links, v))
        stage.drop(links, wanted, v)
        own, other = d.toDF("src", "dst", "d", "ru", "rw"), d.select(F.col("u").alias("hub"), F.col("w").alias("dst"), F.col("d").alias("dc"), F.col("ru").alias("rc"))
        return pairs.join(own, ["src", "dst"]).join(other, ["hub", "dst"]).withColumn("m", F.abs(F.col("d") - F.col("dc"))).withColumn("e", F.col("ru") + 2 * F.col("rw") + F.col("rc"))

    surely = F.coalesce(F.col("m") + F.col("e") < eps, F.lit(False))
    never = F.coalesce((F.col("m") - F.col("e")).between(eps, 1e300), F.lit(False))  # not where it is NaN or infinite
    rest, near = x.filter("hub is not null"), x.limit(0).select("src", "dst")
    for form in FORMS:
        m = stage.write(measured(rest, form).select("src", "dst", "hub", surely.alias("near"), (~surely & ~never).alias("open")))
        near = near.unionByName(m.filter("near").select("src", "dst"))
        rest = m.filter("open").select("src", "dst", "hub")
        if rest.isEmpty():
            break
    explained = F.coalesce("explained", F.lit(False))
    x = x.join(near.distinct().withColumn("explained", F.lit(True)), ["src", "dst"], "left")
    return x.select("src", "dst", F.col("hub").isNotNull().alias("confounded"), explained.alias("explained"), (~explained).alias("passed"))
