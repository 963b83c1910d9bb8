"""Walks over typed parent graphs, remaps and connected components, as joins until nothing changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys
from ..storage import released, sized, stored

IDENTITY = "relationship = 'quantized' or (relationship = 'variant' and axis in ('version', 'mode'))"
FAMILY = "relationship = 'quantized' or (relationship = 'variant' and axis in ('version', 'mode', 'training_stage', 'size', 'tier'))"
LINEAGE = "relationship in ('quantized', 'finetune', 'merge', 'adapter')"
INHERITED = "relationship in ('variant', 'quantized')"


def edges(nodes: DataFrame, parents: str = "parents") -> DataFrame:
    """(child, parent, relationship, axis, pos) of nodes with a parent list; self-edges are dropped."""
    e = nodes.select(F.col("id").alias("child"), F.posexplode(parents).alias("pos", "_p")).select("child", F.col("_p.id").alias("parent"), F.col("_p.relationship").alias("relationship"), F.col("_p.axis").alias("axis"), "pos")
    return e.where("parent is not null and parent <> child")


def next_step(edges_: DataFrame, nodes: DataFrame, condition: str | Column, same_org: str | None = None) -> DataFrame:
    """(id, up): each node's least allowed parent, null where it has none or that parent isn't a node.

    The least is taken before looking whether it exists. ``same_org`` names the nodes' org column that both ends
    must share; nulls share nothing.
    """
    e = edges_.where(condition)
    if same_org:
        org = nodes.select("id", same_org)
        e = e.join(org.select(F.col("id").alias("child"), F.col(same_org).alias("_co")), "child").join(org.select(F.col("id").alias("parent"), F.col(same_org).alias("_po")), "parent", "left")
        e = e.where("_po is null and _co is not null or _co = _po").withColumn("_gone", F.col("_po").isNull())
        # A parent outside the table has no org; it can still be the least and stop the walk.
        ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
        e = e.join(ids, "parent", "left").where("_co = _po or _known is null")
    least = e.groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("up"))
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("_k"))
    return nodes.select("id").join(least, "id", "left").join(known, "up", "left").select("id", F.when(F.col("_k"), F.col("up")).alias("up"))


def walk_up(steps: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, root, depth): the end of each node's walk over (id, up), which stops before a node it has seen.

    Each round doubles the distance looked ahead, so a chain of any length takes logarithmically many rounds. A
    walk that runs into a cycle ends at the node before the place where it came in.
    """
    steps = sized(steps.select("id", "up"))
    n, last = steps.count(), None
    # Ends are in ``steps`` only; the rounds store who has somewhere to go, and each takes the place of the one before.
    ends = steps.where("up is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"))
    jump = steps.where("up is not null").select("id", F.col("up").alias("at"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done"))
    for k in range(most_rounds):
        # After k rounds 2**k hops are looked ahead; who isn't done by n hops has gone into a cycle.
        if 2**k > n or jump.where("not done").isEmpty():
            break
        over = jump.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_d"), F.col("done").alias("_done"))
        # Who is done stays as it is; only the others are joined again. Who isn't found here is an end.
        ahead = jump.where("not done").join(over, "at", "left").select("id", F.coalesce("_at", "at").alias("at"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.coalesce("_done", F.lit(True)).alias("done"))
        jump = sized(ahead.unionByName(jump.where("done")))
        if last is not None:
            released(last)
        last = jump
    else:
        raise RuntimeError("the walk did not settle")
    done = jump.where("done").select("id", F.col("at").alias("root"), "depth").unionByName(ends)
    loose = jump.where("not done")
    if loose.isEmpty():
        return done
    return done.unionByName(_into_cycles(steps.join(loose.select("id"), "id", "left_semi"), loose.select(F.col("at").alias("id")).distinct()))


def _into_cycles(steps: DataFrame, members: DataFrame) -> DataFrame:
    """(id, root, depth) of walks that end in cycles, whose ``members`` are given."""
    members = sized(members)
    inside = members.withColumn("_in", F.lit(True))
    steps = sized(steps.join(inside, "id", "left"))
    entries = walk_up(steps.select("id", F.when(F.col("_in").isNull(), F.col("up")).alias("up")))
    ring = steps.where("_in").select("id", "up")
    # Each member's cycle is named by its least member, found by doubling; the count of members is the length.
    state = ring.select("id", F.col("up").alias("at"), F.least("id", "up").alias("least"))
    for _ in range(members.count().bit_length()):
        over = state.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("least").alias("_l"))
        state = sized(state.join(over, "at").select("id", F.col("_at").alias("at"), F.least("least", "_l").alias("least")))
    lengths = state.join(state.groupBy("least").agg(F.count("*").alias("_n")), "least").select(F.col("id").alias("_entry"), "_n")
    before = ring.select(F.col("up").alias("_entry"), F.col("id").alias("root"))
    out = entries.select("id", F.col("root").alias("_entry"), "depth").join(before, "_entry").join(lengths, "_entry")
    return out.select("id", "root", (F.col("depth") + F.col("_n") - 1).alias("depth"))


def derive_lineage(models: DataFrame, same_org: str = "org_id") -> DataFrame:
    """Add model_group_id, model_family_id (self at the root), lineage_origin_model_id (null at the origin) and its org."""
    own = models.select(F.col("id").alias("child"), F.col(same_org).alias("_co"), F.explode("parents").alias("_p")).select("child", "_co", F.col("_p.id").alias("parent"), "_p.relationship", "_p.axis")
    far = models.select(F.col("id").alias("parent"), F.col(same_org).alias("_po"), F.lit(True).alias("_known"))
    # As in ``next_step``, for all three graphs over one join: the least parent is taken before looking whether it exists.
    e = own.where("parent is not null and parent <> child").join(far, "parent", "left")
    shared = "(_co = _po or _known is null and _co is not null)"
    kinds = {"group": f"({IDENTITY}) and {shared}", "family": f"({FAMILY}) and {shared}", "origin": LINEAGE}
    least = e.groupBy(F.col("child").alias("id")).agg(*(F.min(F.when(F.expr(c), F.struct("parent", "_known"))).alias(f"_{kind}") for kind, c in kinds.items()))
    # One walk over the three graphs side by side: its nodes are (kind, id).
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    step = lambda kind: F.struct(node(kind, "id").alias("id"), F.when(F.col(f"_{kind}._known"), node(kind, f"_{kind}.parent")).alias("up"))
    steps = models.select("id").join(least, "id", "left").select(F.explode(F.array(*map(step, kinds))).alias("_s")).select("_s.*")
    ends = walk_up(steps)
    root = lambda kind: F.max(F.when(F.col("id.kind") == kind, F.col("root.id")))
    roots = ends.groupBy(F.col("id.id").alias("id")).agg(root("group").alias("model_group_id"), root("family").alias("model_family_id"), root("origin").alias("_origin"))
    org = models.select(F.col("id").alias("_origin"), F.col(same_org).alias("_oorg"))
    out = models.drop("model_group_id", "model_family_id", "lineage_origin_model_id", "lineage_origin_model_org_id")
    out = out.join(roots, "id").join(org, "_origin", "left")
    return out.withColumn("lineage_origin_model_id", F.nullif("_origin", "id")).withColumn("lineage_origin_model_org_id", F.coalesce("_oorg", same_org)).drop("_origin", "_oorg")


def inherit(nodes: DataFrame, attributes: str | list[str], condition: str = INHERITED, most_rounds: int = 64) -> DataFrame:
    """(id, the attributes): for each attribute a node's own value, else the first explicit one up its walk.

    One walk serves all attributes. After k rounds a row holds what 2**k nodes of its walk give and the node behind them
    (``at``); it is settled once every attribute has a value or the walk has ended. Only open rows are joined again.
    A walk into a cycle ends when it has seen the whole cycle. Repeated ids are an error of the caller.
    """
    names = [attributes] if isinstance(attributes, str) else list(attributes)
    lacking = reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names))
    step = next_step(edges(nodes), nodes, condition).join(nodes.select("id", *names), "id")
    state = sized(step.select("id", F.when(lacking, F.col("up")).alias("at"), *names))
    n = state.count()
    for k in range(most_rounds):
        waiting = state.where("at is not null")
        # What is left open after as many hops as there are nodes goes round a cycle without a value.
        if 2**k > n or waiting.isEmpty():
            return state.drop("at")
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("_at"), *(F.col(c).alias(f"_{c}") for c in names))
        both = waiting.join(ahead, "at").select("id", "_at", *(F.coalesce(c, f"_{c}").alias(c) for c in names))
        moved = both.select("id", F.when(lacking, F.col("_at")).alias("at"), *names)
        before, state = state, sized(moved.unionByName(state.where("at is null")))
        released(before)
    raise RuntimeError("the walk did not settle")


def benchmark_family(benchmarks: DataFrame, families: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, root): up the parent column to the first benchmark that a family lists; else the end of the walk."""
    listed = families.select(F.explode("benchmark_ids").alias("id")).distinct().withColumn("_f", F.lit(True))
    known = benchmarks.select(F.col("id").alias("parent_benchmark_id"), F.lit(True).alias("_k"))
    b = benchmarks.select("id", "parent_benchmark_id").join(listed, "id", "left").join(known, "parent_benchmark_id", "left")
    up = F.when(F.col("_f").isNull() & F.col("_k") & (F.col("parent_benchmark_id") != F.col("id")), F.col("parent_benchmark_id"))
    return walk_up(b.select("id", up.alias("up")), most_rounds).select("id", "root")


def repoint(edges_: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges with both ends mapped (remap: loser, winner); self-edges go, of equal ones the first place stays."""
    out = edges_
    for c in ("child", "parent"):
        out = out.join(remap.select(F.col("loser").alias(c), F.col("winner").alias("_w")), c, "left").withColumn(c, F.coalesce("_w", c)).drop("_w")
    out = out.where("child <> parent")
    first = out.groupBy("child", "parent").agg(F.min(F.struct("pos", "relationship", "axis")).alias("_e"))
    return first.select("child", "parent", "_e.relationship", "_e.axis", "_e.pos")


def compress_remap(remap: DataFrame) -> DataFrame:
    """(loser, winner) with every winner at the end of its own chain."""
    remap = sized(remap, "pairs")
    nodes = remap.select(F.col("loser").alias("id")).unionByName(remap.select(F.col("winner").alias("id"))).distinct()
    once = remap.groupBy(F.col("loser").alias("id")).agg(F.min("winner").alias("up")).where("up <> id")
    ends = walk_up(nodes.join(once, "id", "left"))
    return ends.where("root <> id").select(F.col("id").alias("loser"), F.col("root").alias("winner"))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour on one side of each node to the least node it knows of.

    Both sides are grouped minima and joins, so a node with any number of links is split by Spark.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(``id``, ``component``) for every node of ``links``: the least node it is connected to.

    Large-star and small-star steps alternate until nothing changes. Nulls and self-links are ignored; repeated links
    and either direction count once; an empty table gives an empty result. Each round is stored, so the plan doesn't
    grow; the number of rounds grows with the logarithm of the longest path.
    """
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    pairs = stored(pairs, "links")
    seen = None
    for _ in range(most_rounds):
        pairs = stored(_star(_star(pairs, True), False), "stars")
        # A fixed point maps every node straight to its component; a sum of row hashes shows it.
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("id")).distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("id")))


def immediate_parent(df: DataFrame) -> DataFrame:
    """Add ``parent_canonical_id``: the first variant parent."""
    return df.withColumn("parent_canonical_id", F.get(F.filter("parents", lambda p: p["relationship"] == "variant"), F.lit(0))["id"])


def family_chain(df: DataFrame, family: str, leaf: str, kinds: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """Nodes between a family and its members: (id, parent, relationship, axis, token), one for each segment behind the family.

    Members are compared with the family's dashed spelling, ids keep the family's own; a member without that prefix gives
    nothing. ``kinds`` types the tokens (see ``keys.suffix_segments``). Of nodes that several members give, the one of the
    smallest member stays.
    """
    dashed = F.replace(F.col(family), F.lit("."), F.lit("-"))
    out = df.select(F.col(family).alias("_f"), F.replace(F.col(leaf), F.lit("."), F.lit("-")).alias("_l"), F.concat(dashed, F.lit("-")).alias("_d")).where("startswith(_l, _d)")
    out = out.withColumn("_t", keys.suffix_segments(F.expr("substring(_l, length(_d) + 1)"), kinds))
    out = out.select("_f", "_l", "_t", F.posexplode("_t").alias("pos", "_s"))
    chain = lambda n: F.concat_ws("-", F.col("_f"), F.slice(F.col("_t")["token"], F.lit(1), n))
    out = out.select("_l", chain(F.col("pos") + 1).alias("id"), F.when(F.col("pos") == 0, F.col("_f")).otherwise(chain(F.col("pos"))).alias("parent"), "_s.*")
    return out.groupBy("id").agg(F.min_by(F.struct("parent", "relationship", "axis", "token"), "_l").alias("_n")).select("id", "_n.*")
