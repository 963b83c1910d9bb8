"""Whole jobs put together from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import keys
from ..functions.keys import FuzzyRules
from ..operators import attributes, catalogue, changes, checks, enrichment, facts, graph, match, merge, minting, reconcile
from ..sources import publish
from ..storage import released, sized


def resolve_mentions(mentions: DataFrame, aliases: DataFrame, entities: DataFrame, fields: list[str], **options) -> DataFrame:
    """Resolve a batch and add fields of the matched entities."""
    return match.enrich(match.resolve(mentions, aliases, **options), entities, fields)


def sync_records(records: DataFrame, aliases: DataFrame, entities: DataFrame, rules: FuzzyRules | None = None, known_facts: DataFrame | None = None, run_id: str = "sync", now: str = "", rerun: bool = False, repos: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Records to facts, drafts, draft aliases, log and the run's summary.

    ``known_facts`` are facts stored before: facts of the same id replace them (of several, that of the last record), the others
    stay (``all_facts``). The log names drafts too. A rerun also
    compares the stored aliases of the mentions with what they resolve to now (``refreshed``). All distinct mentions are resolved at once; what is left open gets drafts by match key (``minting.mint_dependents``; ``repos`` has what
    is known of repos), so spelling twins share one whatever the order of the records. Attested repos that aren't registered are minted too.
    """
    rows = facts.result_rows(records)
    mentions = facts.mentions_of(rows).distinct()
    # Distinct mentions are few beside the facts; all outputs read this one table.
    resolved = sized(match.resolve(mentions, aliases, rules=rules, **options))
    # What nothing matches, and attested repos that nobody has registered.
    ids_ = entities.where("entity_type = 'model'").select(F.col("id").alias("canonical_id"))
    attested = resolved.where("startswith(strategy, 'attested')").join(ids_, "canonical_id", "left_anti")
    open_ = checks.unresolved(resolved).select(*match.KEY, F.lit(None).cast("string").alias("attested_id")).unionByName(attested.select(*match.KEY, F.col("canonical_id").alias("attested_id")))
    minted = minting.mint_dependents(open_, entities, aliases, repos, options.get("org_map"))
    drafts, made = minted["drafts"], sized(minted["aliases"])
    key = ["raw_value", "entity_type"]
    new = drafts.select("entity_type", F.col("id").alias("canonical_id"), F.lit(True).alias("_made"))
    ids = made.join(new, ["entity_type", "canonical_id"], "left").select(*key, F.coalesce("source_config", F.lit("")).alias("_s"), F.col("canonical_id").alias("_d"), "_made").distinct()
    full = resolved.withColumn("_s", F.coalesce("source_config", F.lit(""))).join(ids, [*key, "_s"], "left").withColumn("created_new", F.coalesce("_made", F.lit(False))).withColumn("canonical_id", F.coalesce("_d", "canonical_id")).drop("_s", "_d", "_made")
    full = sized(full)
    numbered = facts.flatten_records(rows, full, numbered=True)
    out = {"facts": numbered.drop("seq"), "drafts": drafts.drop("_k"), "aliases": made, "log": changes.log_rows(full, run_id, now)}
    if known_facts is not None:
        out["all_facts"] = changes.upsert(known_facts, numbered, now=now or None)
    if rerun:
        noted = aliases if "notes" in aliases.columns else aliases.withColumn("notes", F.lit(None).cast("string"))
        out["refreshed"] = changes.refresh_aliases(match.compare_stored(noted, resolved.dropDuplicates(match.KEY)))
    out["run"] = changes.run_summary(run_id, records, aliases, aliases.select("raw_value").unionByName(made.select("raw_value")), drafts, resolved.where("false"), rerun)
    return out


def settle_models(layers: DataFrame, org_map: DataFrame, scalars: list[str], unions: list[str], orgs: DataFrame | None = None, weak: DataFrame | None = None, weak_fields: list[str] = (), never: DataFrame | None = None, prefer: DataFrame | None = None, forced: DataFrame | None = None) -> dict[str, DataFrame]:
    """Layered entries to models: merged by rank, attributed, collisions folded, edges repointed, gaps filled, attributes and lineage derived.

    ``layers``: id, layer_rank, file, pos, the scalars (``display_name``, ``org_id``, ``resolution_source`` among them) and lists, and where
    there are any, ``parents``. ``never``, ``prefer`` and ``forced`` steer the folds (``merge.fold_collisions``). ``weak`` (id, the weak fields,
    and their order) fills what is still empty after the folds, under the winners' ids, but no date that the id itself tells.
    Gives ``models``, ``remap``, ``attributed`` (before the folds) and, with ``orgs``, the ``orgs`` that have to be added.
    """
    if "parents" not in layers.columns:
        layers = layers.withColumn("parents", F.array().cast(reconcile.EDGES))
    merged = sized(merge.merge_layers(layers, scalars, unions, edges="parents"), "merged")
    attributed, merges = match.attribute_orgs(merged, org_map)
    # Folds, edges and models all start from these rows.
    attributed = sized(attributed, "attributed")
    source = F.col("resolution_source")
    ranked = attributed.withColumn("source_rank", F.when(source == "curated", 2).when(source == "hf", 1).otherwise(0)).withColumn("is_real", F.coalesce(source.isin("curated", "hf"), F.lit(False)))
    wanted = merges.select(F.col("id").alias("loser"), F.col("into").alias("winner"))
    remap = sized(merge.fold_collisions(ranked, never, prefer, wanted if forced is None else wanted.unionByName(forced)), "remap")
    released(merged)
    folded = sized(merge.apply_remap(attributed, remap, unions), "kept")
    links = graph.repoint(graph.edges(attributed), remap).join(folded.select(F.col("id").alias("child")), "child", "left_semi")
    edge = F.struct(F.col("parent").alias("id"), "relationship", "axis").alias("e")
    lists = links.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", edge))).alias("_l")).select("id", F.transform("_l", lambda x: x["e"]).alias("parents"))
    models = folded.drop("parents").join(lists, "id", "left").withColumn("parents", F.coalesce("parents", F.array().cast(reconcile.EDGES)))
    if weak is not None:
        moved = weak.join(remap.select(F.col("loser").alias("id"), "winner"), "id", "left").withColumn("id", F.coalesce("winner", "id")).drop("winner")
        if "release_date" in weak_fields:
            moved = moved.withColumn("release_date", F.when(keys.id_date(F.col("id")).isNull(), F.col("release_date")))
        if "explicit_keys" not in models.columns:
            models = models.withColumn("explicit_keys", F.array().cast("array<string>"))
        models = merge.fill_weak(models, moved, list(weak_fields))
    named = sized(models.withColumn("display_name", F.coalesce("display_name", keys.display_name(F.col("id")))), "folded")
    released(folded)
    inherited = ("open_weights",) if "open_weights" in named.columns else ()
    return {**attributes.derive(named, org_map, orgs, inherited), "remap": remap, "attributed": attributed}


def build_registry(
    layers: DataFrame, org_map: DataFrame, scalars: list[str], unions: list[str], orgs: tuple[DataFrame, DataFrame] | None = None, benchmarks: tuple[DataFrame, DataFrame] | None = None, benchmark_fields: list[str] = ("display_name",), scoped: DataFrame | None = None,
    before: dict[str, DataFrame] | None = None, **settings,
) -> dict[str, DataFrame]:
    """The whole registry from its layers: ``models``, ``orgs``, ``benchmarks``, ``aliases``, ``claims``, ``remap``, ``checks``; after pruning, ``entities`` too.

    ``orgs`` and ``benchmarks`` are (generated, curated). A curated org takes the place of a generated one (id, hf_org, display_name, aliases, kind, seq; where
    none are given, models seed their aliases without ranks); a curated benchmark overrides the fields it states (``explicit_keys``). Orgs that models name and
    nobody lists get a row. ``before`` has the stored ``aliases`` (id, entity_type, raw_value, source_config, canonical_id, strategy) and ``entities``
    (entity_type, id, review_status): what an earlier seed left in them and this one lacks goes, but for orgs that models still name, and entities that other aliases use.
    ``settings`` go to ``settle_models``; ``checks`` has every offender (``checks.report``).
    """
    generated = None if orgs is None else sized(merge.replace_whole(*orgs), "orgs")
    made = settle_models(layers, org_map, scalars, unions, generated, **settings)
    models = sized(made["models"], "models")
    released(made["attributed"])
    model_rows = models.withColumn("entity_type", F.lit("model"))
    out = {"models": models, "remap": made["remap"]}
    rows = []
    if benchmarks is not None:
        out["benchmarks"] = sized(merge.override_merge(*benchmarks, list(benchmark_fields), ["aliases"]), "benchmarks")
        rows.append(out["benchmarks"].withColumn("entity_type", F.lit("benchmark")))
    if generated is None:
        aliases, claims = changes.seed_aliases(model_rows, scoped)
        out |= {"aliases": aliases, "claims": claims}
    else:
        new = made["orgs"].withColumn("aliases", F.array().cast("array<string>")).withColumn("seq", F.lit(None).cast("long"))
        out["orgs"] = all_orgs = sized(generated.unionByName(new, allowMissingColumns=True), "all_orgs")
        rows.append(all_orgs.withColumn("entity_type", F.lit("org")))
        ranked = {"entity_type": "string", "id": "string", "display_name": "string", "aliases": "array<string>", "org_id": "string", "resolution_source": "string", "review_status": "string", "seq": "long"}
        table = [r.select(*((F.col(c) if c in r.columns else F.lit(None)).cast(kind).alias(c) for c, kind in ranked.items())) for r in (model_rows, *rows)]
        seeded = minting.seed_by_rank(reduce(DataFrame.unionByName, table), all_orgs, org_map, scoped)
        out |= {"aliases": seeded["aliases"], "claims": seeded["claims"]}
    if before is not None:
        kept = reduce(DataFrame.unionByName, (r.select("id") for r in (model_rows, *rows))).distinct()
        named = models.select(F.explode(F.array("org_id", "lineage_origin_model_org_id")).alias("id"))
        if generated is not None and "parent_org_id" in generated.columns:
            named = named.unionByName(generated.select(F.col("parent_org_id").alias("id")))
        out["kept_aliases"], out["entities"] = changes.prune_stale(before["aliases"], before["entities"], out["aliases"], kept, named.where("id is not null").distinct())
    out["checks"] = checks.report(models, out["aliases"], out["claims"], out.get("orgs"), out.get("benchmarks"))
    return out


def add_lineage(models: DataFrame) -> DataFrame:
    """Models with the derived lineage columns and inherited open weights."""
    open_ = graph.inherit(models, "open_weights")
    return graph.derive_lineage(models).drop("open_weights").join(open_, "id", "left")


def oracle_layer(truth: DataFrame, models: DataFrame, org_map: DataFrame, deny: DataFrame) -> dict[str, DataFrame]:
    """Known answers (raw_value, fixed_id, status) as a layer over ``models`` (id, parents).

    ``targets``: each true id with what becomes of it (ok, rekey an incumbent of other spelling, mint); ``aliases``: the
    mentions that lead to it, but for near misses that would change what is meant (``refused``); ``edges``: the models' edges
    with re-keyed ids at both ends.
    """
    fixed = truth.where("status in ('fixed_exact', 'fixed_near_miss') and contains(fixed_id, '/')").select("raw_value", "fixed_id", "status").distinct()
    near = fixed.where("status = 'fixed_near_miss'").select(F.col("raw_value").alias("raw"), F.col("fixed_id").alias("fixed"))
    good = sized(match.guard_redirects(near, deny, org_map).select("raw", "fixed").distinct())
    targets = sized(catalogue.partition_targets(fixed.select(F.col("fixed_id").alias("id")), models.select("id")))
    pairs = fixed.where("status = 'fixed_exact'").select("raw_value", F.col("fixed_id").alias("canonical_id")).unionByName(good.select(F.col("raw").alias("raw_value"), F.col("fixed").alias("canonical_id")))
    remap = targets.where("action = 'rekey'").select(F.col("incumbent").alias("loser"), F.col("id").alias("winner"))
    return {"targets": targets, "aliases": pairs.where("raw_value <> canonical_id").distinct(), "refused": near.join(good, ["raw", "fixed"], "left_anti"), "edges": graph.repoint(graph.edges(models), remap)}


def refresh_catalogue(records: DataFrame, existing: DataFrame, org_map: DataFrame) -> dict[str, DataFrame]:
    """Provider rows to groups; groups that fold onto an existing model give it their spellings, the others are minted."""
    groups = merge.group_catalogue(records)
    heads = merge.pick_heads(groups)
    vendor = match.vendor_by_token(heads, "grp", org_map.select(F.col("name").alias("token"), F.col("org").alias("vendor")))
    forms = groups.groupBy("grp").agg(F.array_sort(F.collect_set("model_id")).alias("forms"))
    mints = vendor.join(forms, "grp").select(F.col("grp").alias("id"), F.col("vendor").alias("org"), "forms", "release_date", "open_weights", "name")
    folds = match.decide_folds(mints, existing, org_map)
    owned = mints.join(folds, "id").select("target", F.explode("forms").alias("form")).distinct()
    return {"minted": mints.join(folds, "id", "left_anti"), "enriched": owned, "folds": folds}


def audit(mentions: DataFrame, aliases: DataFrame, top: int = 20, **options) -> dict[str, DataFrame]:
    """Coverage by type and strategy, by spread, and the most frequent open mentions."""
    frequency = facts.mention_frequency(mentions)
    resolved = match.resolve(mentions.select(*match.KEY).distinct(), aliases, **options)
    return {"coverage": facts.coverage(frequency, resolved), "strata": facts.stratified_coverage(frequency, resolved), "unmatched": facts.top_unmatched(frequency, resolved, top)}


def regenerate_catalogue(
    records: DataFrame, org_map: DataFrame, repos: DataFrame, committed: DataFrame, independent: DataFrame, derived: DataFrame, external: DataFrame | None = None, denied: DataFrame | None = None,
    skip: DataFrame | None = None, casing: DataFrame | None = None, distinct_orgs: DataFrame | None = None, weak: tuple[str, ...] = ("family",), hosts: tuple[str, ...] = (), migrate: bool = False,
    rules: keys.CatalogueRules | None = None,
) -> dict[str, DataFrame]:
    """A provider catalogue to the next generation of entries, in order: group, defer to repos or adopt an external key or mint, attach the
    providers' spellings, merge what is the same, carry the committed generation forward, reconcile with other sources, settle orgs.

    ``records``: provider, model_id, family, name, release_date, open_weights, pos and, where known, platform. ``repos``: known repos as in
    ``match.defer_targets``; ``external``: keys that a group without a repo may take as its id (not those in ``denied``). ``committed``, ``independent`` and
    ``derived`` are entries (see ``reconcile``). ``rules`` tell how the providers spell ids. Besides ``entries``, the steps' own outputs: claims, remap, report, suppressed, vetoed, dropped.
    """
    groups = sized(merge.group_catalogue(records, rules), "groups")
    named = sized(merge.pick_heads(groups).withColumn("_name", keys.catalogue_name(F.col("spelling"), rules, variants=False)), "heads")
    heads = match.vendor_by_token(named, "grp", org_map.select(F.col("name").alias("token"), F.col("org").alias("vendor")))
    slugged = keys.slug(F.col("_name"))
    mints = heads.select("grp", F.concat_ws("/", F.col("vendor"), slugged).alias("mint"), F.col("vendor").alias("org_id"), "name", "family", "release_date", "open_weights")
    mints = sized(mints, "mints")
    spelled = groups.select("grp", F.col("model_id").alias("form")).unionByName(mints.select("grp", F.col("mint").alias("form"))).distinct()
    names = spelled.groupBy("grp").agg(F.collect_set("form").alias("forms")).join(mints.select("grp", "org_id"), "grp").where("org_id is not null")
    deferred = match.defer_targets(names.select(F.col("grp").alias("id"), F.col("org_id").alias("org"), "forms"), repos, org_map).select(F.col("id").alias("grp"), F.col("target").alias("_repo"))
    rows = mints.join(deferred, "grp", "left")
    if external is None:
        rows = rows.withColumn("_key", F.lit(None).cast("string"))
    else:
        free = rows.where("_repo is null and org_id is not null").select(F.col("mint").alias("id"), "org_id").distinct()
        rows = rows.join(merge.adopt_external_ids(free, external, denied).select(F.col("id").alias("mint"), F.col("key").alias("_key")), "mint", "left")
    rows = rows.withColumn("id", F.coalesce("_repo", "_key", "mint")).withColumn("deferred", F.col("_repo").isNotNull()).withColumn("adopted", F.col("_repo").isNull() & F.col("_key").isNotNull())
    rows = sized(rows.drop("_repo", "_key"), "adopted")
    platform = F.col("platform") if "platform" in groups.columns else F.lit(None).cast("string")
    attached = _attached(rows, org_map, groups.select("grp", "model_id", "pos", platform.alias("platform")), rules)
    hosted = attached.where("form <> id").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("form", "platform")))).alias("platforms"))
    one = rows.groupBy("id").agg(
        *(F.min_by(c, "grp").alias(c) for c in ("org_id", "family")), F.min(F.coalesce("name", keys.display_name(F.col("mint")))).alias("display_name"), F.min("release_date").alias("release_date"), F.bool_or("open_weights").alias("open_weights"),
        F.bool_or("deferred").alias("deferred"), F.bool_or("adopted").alias("adopted"), F.collect_set("mint").alias("_m"),
    )
    one = one.join(hosted, "id", "left").withColumn("aliases", F.array_sort(F.array_except(F.array_union("_m", F.coalesce(F.map_keys("platforms"), F.array().cast("array<string>"))), F.array("id")))).drop("_m")
    batch = reconcile.reconcile_batch(sized(one.withColumn("review_status", F.lit("draft")), "one"), org_map, weak)
    carried = reconcile.carry_forward(batch["entries"], committed, org_map, weak, skip, independent.select(F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"), "id"), hosts, migrate)
    claims = sized(carried["claims"], "claims")
    out = reconcile.reconcile_existing(carried["entries"], independent, derived, org_map, weak, claims)
    entries = out["entries"]
    if casing is not None and distinct_orgs is not None:
        entries = merge.canonicalize_orgs(entries, "org_id", org_map, casing, distinct_orgs)
    return {"entries": entries, "claims": claims, "remap": batch["remap"].unionByName(carried["remap"]), "report": carried["report"], "suppressed": out["suppressed"], "vetoed": out["vetoed"], "dropped": batch["dropped"], "lost": out["lost"]}


def _attached(entries: DataFrame, org_map: DataFrame, rows: DataFrame, rules: keys.CatalogueRules | None = None) -> DataFrame:
    """(id, form, platform): what providers' rows of a group are known by, for the entry that they name: variants and other sizes are none.

    A row may name the entry with its org's brand in front.
    """
    named = lambda c: keys.catalogue_name(c, rules, variants=False)
    spelled = sized(rows.withColumn("_n", named(F.col("model_id"))), "cleaned").withColumn("name", F.substring_index("_n", "-", 1)).join(org_map.select("name", F.col("org").alias("_brand")), "name", "left").drop("name")
    whole = F.struct(F.lit(False).alias("bare"), keys.catalogue_signature(F.col("_n")).alias("_i"))
    bare = F.struct(F.lit(True).alias("bare"), keys.catalogue_signature(F.regexp_replace("_n", "^[^-]*-", "")).alias("_i"))
    spelled = sized(spelled.withColumn("_x", F.explode(F.array_compact(F.array(whole, F.when(F.col("_brand").isNotNull() & F.col("_n").contains("-"), bare))))).select("*", "_x.*").drop("_x"), "spelled")
    e = entries.select("id", "grp", "org_id", keys.catalogue_signature(named(F.regexp_replace("id", r"^[^/]*/", ""))).alias("_i"))
    fits = spelled.join(sized(e, "named"), ["grp", "_i"]).where("not bare or _brand = org_id").select("id", F.explode(keys.surface_forms(F.col("model_id"), F.col("_n"), F.col("org_id"))).alias("form"), "platform", "pos")
    fits = sized(fits, "fits")
    stolen = match.stolen_forms(fits.select("form", "id").distinct(), entries.select(F.col("id").alias("form"), "id"))
    fits = fits.join(stolen.select("form", "id"), ["form", "id"], "left_anti")
    return fits.groupBy("id", "form").agg(F.min_by("platform", F.when(F.col("platform").isNotNull(), F.col("pos"))).alias("platform"))


def refresh_enrichment(entries: DataFrame, spellings: DataFrame, repos: DataFrame, org_map: DataFrame, path: str, tag: str | None = None) -> str:
    """Enrich known entries (``enrichment.enrich_known``) and publish the rows under ``path``: ``written``, ``same`` or ``skipped``.

    It is skipped, and the large table isn't read, where the snapshot ``tag`` was asked for all candidates before and a result is there. Without a
    tag it always runs. What was asked for is noted last, so a run that breaks off is done again. Entries that aren't found any more keep what was
    published for them, as removed.
    """
    spark = entries.sparkSession
    wanted = sized(enrichment.candidates(entries, spellings), "candidates")
    new = wanted.join(publish.checked_ids(spark, f"{path}/_checked", tag), "id", "left_anti")
    there = "enrichment" in publish.load_manifest(spark, path)
    if there and new.isEmpty():
        return "skipped"
    committed = publish.read_published(spark, path, "enrichment") if there else None
    said = publish.publish({"enrichment": enrichment.enrich_known(entries, spellings, repos, org_map, committed)}, path)["enrichment"]
    if tag is not None:
        new.select(F.lit(tag).alias("snapshot_tag"), "id").write.mode("append").parquet(f"{path}/_checked")
    return said
