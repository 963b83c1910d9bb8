"""The residual layer: what no other layer matches gets an entity of its own, such that a run over its own output changes nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import keys
from ..storage import sized
from . import match, merge, minting

EDGE = "struct<id:string,relationship:string,axis:string>"


def record_forms(entries: DataFrame) -> DataFrame:
    """(home, form, pos) of entries: the id first where they define it (have a display name), then the aliases."""
    own = F.when(F.col("display_name").isNotNull(), F.array("id")).otherwise(F.array().cast("array<string>"))
    return entries.select(F.col("id").alias("home"), F.posexplode(F.concat(own, F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "form")).where("form is not null and form <> ''")


def clean_universe(entities: DataFrame, aliases: DataFrame, prior: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, aliases) without what this layer made before: inferred entities, their aliases, and aliases of forms that only ``prior`` claims.

    Forms of the prior output stand on other entities too, as enrichments or after folds; they go unless another layer claims them (``claims``:
    form, id).
    """
    own = entities.where("resolution_source = 'inferred'").select("id").distinct()
    forms = record_forms(prior).select("form").distinct().join(claims.select("form"), "form", "left_anti")
    left = aliases.join(own.select(F.col("id").alias("canonical_id")), "canonical_id", "left_anti")
    return entities.join(own, "id", "left_anti"), left.join(forms.select(F.col("form").alias("raw_value")), "raw_value", "left_anti")


def residual_layer(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, prior: DataFrame, claims: DataFrame, org_map: DataFrame, curated: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Entries for mentions (raw_value) of models that nothing matches: ``entries``, ``review``, ``lost`` and ``report``.

    ``entities``: id, org_id, resolution_source, aliases, seq; ``aliases``: the alias table; ``prior``: this layer's entries of the last run (id, display_name,
    aliases); ``claims`` (form, id): what other layers claim; ``curated`` (form): what curation places itself. ``options`` go to ``match.resolve``.

    All matching is against the universe without this layer's own output. A mention under a placeholder org that matches without it, exactly or by
    match key, is given to that entity. What is left folds onto an existing entity (``match.decide_folds``, else the same collision key and sizes) or becomes a draft:
    one for each org, name key and sizes (without an org: each id), whose id is the spelling with capitals, the shorter, the smaller. An id that is known as something
    else gets ``-inferred`` behind it. A base in the name gives an edge: a version where only a version follows, else a fine-tune. Drafts without an org are tagged and
    put up for review with the org of their base.

    No form of the prior output is lost: one that is neither emitted nor placed by curation, and matches only by fuzzy rules, is pinned to that entity; one that doesn't match goes with
    the others of its record (the first one pinned), else where its record's id leads, else to the draft that its record's id became, else it is reported as ``lost``.
    ``entries`` without a display name are enrichments: an entity's further forms.
    """
    models, known = clean_universe(entities, aliases, prior, claims)
    models, known = sized(models, "models"), sized(known, "known")
    placed = claims.select("form").limit(0) if curated is None else curated.select("form").distinct()
    lead = F.lower(F.trim(F.substring_index("raw_value", "/", 1)))
    bare_name = F.regexp_replace("raw_value", r"^[^/]*/", "")

    def look(df: DataFrame, column: str) -> DataFrame:
        """(column, to, how) of distinct names."""
        names = df.select(F.col(column).alias("raw_value")).distinct().select("raw_value", F.lit("model").alias("entity_type"), F.lit(None).cast("string").alias("source_config"))
        return match.resolve(names, known, **options).select(F.col("raw_value").alias(column), F.col("canonical_id").alias("to"), F.col("strategy").alias("how"))

    firm = F.col("to").isNotNull() & (F.col("how") != "fuzzy")
    m = mentions.select("raw_value").distinct().withColumn("_sentinel", F.col("raw_value").contains("/") & lead.isin(*minting.NO_ORGS)).withColumn("_bare", F.when(F.col("_sentinel"), bare_name))
    homeless = m.where("_sentinel").join(look(m.where("_sentinel"), "_bare").where(firm), "_bare").select("raw_value", F.col("to").alias("target"), F.lit("sentinel").alias("why"))
    homeless = sized(homeless, "sentinels")
    rest = m.join(homeless, "raw_value", "left_anti")
    rest = sized(rest.join(look(rest, "raw_value").where("to is null").select("raw_value"), "raw_value", "left_semi"), "residual")
    claimed = rest.join(placed.select(F.col("form").alias("raw_value")), "raw_value", "left_semi")
    rest = rest.join(claimed, "raw_value", "left_anti")

    # Drafts that are to be, and what they fold onto.
    has_org = keys.is_repo_id(F.col("raw_value")) & ~F.col("_sentinel")
    new = rest.withColumn("_own", has_org).withColumn("name", F.when(has_org, lead)).join(org_map.select("name", F.col("org").alias("_dev")), "name", "left")
    id_ = F.when(F.col("_own"), F.trim("raw_value")).when(F.col("_sentinel"), F.concat_ws("/", lead, keys.slug(F.col("_bare")))).otherwise(keys.slug(F.col("raw_value")))
    new = new.select("raw_value", F.when(F.col("_own"), F.coalesce("_dev", F.trim(F.substring_index("raw_value", "/", 1)))).alias("org_id"), id_.alias("id"))
    taken = models.select("id").unionByName(known.where("coalesce(status, '') <> 'rejected'").select(F.col("raw_value").alias("id"))).distinct()
    folds = match.decide_folds(new.groupBy("id").agg(F.min("org_id").alias("org"), F.collect_set("raw_value").alias("forms")), models.select("id", F.col("org_id").alias("org"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "seq"), org_map)
    near = models.select(keys.collision_key(F.col("id")).alias("_c"), keys.size_signature(F.col("id")).alias("_s"), F.col("id").alias("_twin")).groupBy("_c", "_s").agg(F.min("_twin").alias("_twin"))
    new = new.join(folds.select("id", "target"), "id", "left").withColumn("_c", keys.collision_key(F.col("id"))).withColumn("_s", keys.size_signature(F.col("id"))).join(near, ["_c", "_s"], "left").drop("_c", "_s")
    new = sized(new.withColumn("target", F.coalesce("target", "_twin")).drop("_twin"), "new")
    folded = new.where("target is not null").select("raw_value", "target", F.lit("fold").alias("why"))
    mint = new.where("target is null").drop("target").join(taken.withColumn("_t", F.lit(True)), "id", "left").withColumn("id", F.when(F.col("_t"), F.concat("id", F.lit("-inferred"))).otherwise(F.col("id"))).drop("_t")
    leaf = F.regexp_replace("id", r"^[^/]*/", "")
    twin = F.when(F.col("org_id").isNotNull(), F.concat_ws("\n", F.lower("org_id"), keys.name_key(leaf), keys.size_signature(F.col("id")).cast("string"))).otherwise(F.lower("id"))
    mint = mint.withColumn("_g", twin)
    best = mint.groupBy("_g").agg(F.min_by("id", F.struct((F.col("id") == F.lower("id")).alias("a"), F.length("id").alias("l"), "id")).alias("_w"))
    mint = sized(mint.join(best, "_g"), "mints")
    base = minting.infer_base_by_token(mint.select(F.col("raw_value").alias("id"), "raw_value"), known, org_map).withColumnRenamed("id", "raw_value")
    mint = sized(mint.join(base, "raw_value", "left"), "based")
    version = F.col("rest").rlike(r"^v?\d+(?:[.-]\d+)*$")
    edge = F.when(F.col("base").isNotNull(), F.struct(F.col("base").alias("id"), F.when(version, "variant").otherwise("finetune").alias("relationship"), F.when(version, "version").alias("axis")))
    forms = mint.select("_w", F.explode(F.array("raw_value", "id")).alias("_f")).groupBy("_w").agg(F.array_sort(F.collect_set("_f")).alias("aliases"))
    drafts = mint.groupBy("_w").agg(F.min(F.when(F.col("id") == F.col("_w"), F.col("raw_value"))).alias("display_name"), F.min("org_id").alias("org_id"), F.min_by(edge, F.when(F.col("base").isNotNull(), F.col("raw_value"))).alias("_e"))
    drafts = drafts.join(forms, "_w").select(
        F.col("_w").alias("id"), "display_name", "org_id", "aliases", F.when(F.col("_e").isNotNull(), F.array("_e")).otherwise(F.array()).cast(f"array<{EDGE}>").alias("parents"),
        F.when(F.col("org_id").isNull(), F.array(F.lit("org-unknown"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    drafts = sized(drafts, "drafts")
    review = mint.where("org_id is null").select("raw_value", F.col("_w").alias("id"), F.col("base").alias("inferred_base"), F.when(F.col("base").contains("/"), F.substring_index("base", "/", 1)).alias("proposed_org"))

    # The floor under what was emitted before.
    given = homeless.unionByName(folded)
    emitted = record_forms(drafts).select("form").unionByName(given.select(F.col("raw_value").alias("form"))).unionByName(given.select(F.col("target").alias("form"))).distinct()
    before = record_forms(prior).join(emitted, "form", "left_anti").join(placed, "form", "left_anti").join(claims.select(F.col("id").alias("form")).distinct(), "form", "left_anti")
    before = sized(before, "before")
    routes = merge.nothing_removed(before, emitted, look(before, "form").select(F.col("form").alias("raw_value"), F.col("to").alias("canonical_id"), F.col("how").alias("strategy")))
    before = before.join(routes.select("form", "canonical_id", "route"), "form").where("route <> 'fine'")
    pinned = before.where("route = 'pinned'").groupBy("home").agg(F.min_by("canonical_id", F.struct("pos", "form")).alias("_first"))
    homes = look(before.select("home").distinct(), "home").where(firm).select("home", F.col("to").alias("_lead"))
    reborn = record_forms(drafts).groupBy(F.lower("form").alias("_l")).agg(F.min("home").alias("_draft"))
    before = before.join(pinned, "home", "left").join(homes, "home", "left").join(reborn, F.lower("home") == F.col("_l"), "left")
    before = sized(before.withColumn("target", F.when(F.col("route") == "pinned", F.col("canonical_id")).otherwise(F.coalesce("_first", "_lead", "_draft"))).select("home", "form", "target"), "floor")
    kept = before.where("target is not null and target <> form").select(F.col("form").alias("raw_value"), "target", F.lit("floor").alias("why"))
    given = given.unionByName(kept)
    more = given.where("raw_value <> target").groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("raw_value")).alias("_more"))
    none = F.array().cast("array<string>")
    entries = drafts.join(more, "id", "full_outer").withColumn("aliases", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("_more", none)))).drop("_more")
    entries = entries.withColumn("resolution_source", F.when(F.col("display_name").isNotNull(), "inferred")).withColumn("review_status", F.when(F.col("display_name").isNotNull(), "draft"))
    counts = [given.groupBy("why").agg(F.count("*").alias("n")), claimed.groupBy(F.lit("curated").alias("why")).agg(F.count("*").alias("n")), drafts.groupBy(F.when(F.col("org_id").isNull(), "org-less").when(F.size("parents") > 0, "based").otherwise("opaque").alias("why")).agg(F.count("*").alias("n"))]
    return {"entries": entries, "review": review, "lost": before.where("target is null").select("home", "form"), "report": reduce(DataFrame.unionByName, counts)}


def apply_layer(entities: DataFrame, aliases: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, aliases) with a residual layer on top, as the next run will meet it; forms that are aliases already stay as they are."""
    full = entries.where("display_name is not null").select("id", "org_id", "resolution_source", "aliases", F.lit(1 << 40).alias("seq"))
    forms = entries.select(F.col("id").alias("canonical_id"), F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw_value")).groupBy("raw_value").agg(F.min("canonical_id").alias("canonical_id"))
    new = forms.join(aliases.select("raw_value"), "raw_value", "left_anti").select("raw_value", F.lit("model").alias("entity_type"), F.lit(None).cast("string").alias("source_config"), "canonical_id", F.lit("confirmed").alias("status"), F.lit(1 << 40).alias("seq"))
    return entities.unionByName(full), aliases.select(new.columns).unionByName(new)
