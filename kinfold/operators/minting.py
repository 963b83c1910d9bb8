"""Drafts for what nothing matches, with what hangs on them: orgs, edges, provenance and aliases; and seeding aliases by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import keys
from ..storage import released, sized
from . import match

#: Families that a name may be built on, in order of precedence, and prefixes that stand for no org.
BASE_TOKENS = (
    "tinyllama", "openhermes", "openchat", "mixtral", "llama", "mistral", "qwen", "gemma", "yi", "phi", "gpt", "claude", "gemini", "falcon", "bloom", "deepseek", "baichuan", "cohere", "command",
    "neural", "solar", "nous", "zephyr", "orca", "dolphin",
)
NO_ORGS = ("unknown", "none", "null", "model", "models", "local")
EDGE = "struct<id:string,relationship:string,axis:string>"
NOT_MINTED = ("family", "composite")


def _prefix(c: Column) -> Column:
    """The org of an id with exactly one part before its name, unless it stands for none."""
    lead = F.trim(F.substring_index(c, "/", 1))
    return F.when(keys.is_repo_id(c) & ~F.lower(lead).isin(*NO_ORGS), lead)


def infer_base_by_token(drafts: DataFrame, aliases: DataFrame, org_map: DataFrame, tokens: tuple[str, ...] = BASE_TOKENS) -> DataFrame:
    """(id, base, rest): of drafts (id, raw_value) the model that the longest stem of their name's base token on names, by an exact or normalized alias.

    The first token of ``tokens`` that a word equals, or begins with before a digit, tells where stems start. A stem under the org
    goes before the bare one of its length. What is the same name as the draft is no base. ``rest``: the words behind the stem, dashed.
    """
    name = F.regexp_replace("raw_value", r"^[^/]*/", "")
    words = F.filter(F.split(F.lower(name), r"[\s\-_/.:]+"), lambda w: w != "")
    d = drafts.select("id", "raw_value", words.alias("_w"), name.alias("_name"), F.lower(_prefix(F.col("raw_value"))).alias("name"), _prefix(F.col("raw_value")).alias("_o"))
    # Of each word only its first token in their order can decide; it is looked for once, and in names that hold a token only.
    any_ = "(?:" + "|".join(tokens) + ")"
    d = d.where(F.lower("_name").rlike(any_)).withColumn("_h", F.transform("_w", lambda w: F.regexp_extract(w, rf"^({any_})(?=[0-9]|\z)", 1)))
    start = F.coalesce(*(F.nullif(F.array_position("_h", token), F.lit(0)) for token in tokens))
    d = d.withColumn("_s", start).where("_s is not null").join(org_map.select("name", F.col("org").alias("_d")), "name", "left").withColumn("_o", F.coalesce("_d", "_o"))
    d = d.withColumn("_t", F.expr("slice(_w, cast(_s as int), size(_w))")).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("_t"))))
    stem = F.array_join(F.expr("slice(_t, 1, n)"), "-")
    d = d.select("id", "raw_value", "_name", "n", F.array_join(F.expr("slice(_t, n + 1, size(_t))"), "-").alias("rest"), F.explode(F.array_compact(F.array(F.when(F.col("_o").isNotNull(), F.struct(F.lit(0).alias("bare"), F.concat("_o", F.lit("/"), stem).alias("stem"))), F.struct(F.lit(1).alias("bare"), stem.alias("stem"))))).alias("_x")).select("*", "_x.*").drop("_x")
    d = d.where(keys.index_key(F.col("stem")) != keys.index_key(F.col("raw_value")))
    probe = d.select("stem").distinct()
    hits = match.resolve(probe.select(F.col("stem").alias("raw_value"), F.lit("model").alias("entity_type"), F.lit(None).cast("string").alias("source_config")), aliases, mode="exact").where("canonical_id is not null")
    d = d.join(hits.select(F.col("raw_value").alias("stem"), F.col("canonical_id").alias("base")), "stem")
    nz = lambda c: keys.index_key(c)
    other = (nz(F.col("base")) != nz(F.col("raw_value"))) & (nz(F.regexp_replace("base", r"^[^/]*/", "")) != nz(F.col("_name"))) & (nz(F.col("base")) != nz(F.col("id")))
    return d.where(other).groupBy("id").agg(F.min_by(F.struct("base", "rest"), F.struct((-F.col("n")).alias("n"), "bare")).alias("_b")).select("id", "_b.*")


def mint_dependents(unmatched: DataFrame, entities: DataFrame, aliases: DataFrame, external: DataFrame | None = None, org_map: DataFrame | None = None) -> dict[str, DataFrame]:
    """Drafts for mentions that nothing registered matches, and for the orgs that they need: ``drafts``, ``aliases``, ``reused``.

    ``unmatched`` has raw_value, entity_type, source_config and, where a repo of that name is attested, ``attested_id``. ``external`` repos (id in any case,
    release_date, params_billions, open_weights, relation, base_models) confirm models too. ``aliases`` is the alias table, ``entities`` (id,
    entity_type) all that is registered, ``org_map`` (name, org) the developers behind org names.

    A confirmed model takes the repo's id as it is spelled there, is reviewed, comes from ``hf``, and belongs to its developer, else the repo's org; what is registered up to
    case is ``reused`` instead. Other models are drafts, ``inferred``, under the org that their prefix resolves to; an org that nothing knows is
    minted before them (reviewed and a community for a repo, else a draft). A name without an org is tagged ``org-unknown``. Edges: the repo's bases that are registered; a
    version edge to the family that a dated id names; for inferred ones without any, a fine-tune edge to the base in their name.

    Spellings of one match key share a draft, named by the least of them; an id that is taken gets a hash behind it. Families and composites
    aren't minted. Orgs need no further drafts, so two passes are all.
    """
    spark = unmatched.sparkSession
    named = org_map if org_map is not None else spark.createDataFrame([], "name string, org string")
    m = unmatched if "attested_id" in unmatched.columns else unmatched.withColumn("attested_id", F.lit(None).cast("string"))
    m = m.where(~F.col("entity_type").isin(*NOT_MINTED)).select("raw_value", "entity_type", "source_config", "attested_id").distinct()
    model = F.col("entity_type") == "model"
    m = m.withColumn("_l", F.when(model, F.lower(F.coalesce("attested_id", F.when(keys.is_repo_id(F.col("raw_value")), F.trim("raw_value"))))))
    if external is None:
        m = m.withColumn("_repo", F.when(model, F.col("attested_id")))
    else:
        m = m.join(external.groupBy(F.lower("id").alias("_l")).agg(F.min("id").alias("_x")), "_l", "left").withColumn("_repo", F.when(model, F.coalesce("_x", "attested_id"))).drop("_x")
    there = entities.where("entity_type = 'model'").groupBy(F.lower("id").alias("_r")).agg(F.min("id").alias("_old"))
    m = m.withColumn("_r", F.lower("_repo")).join(there, "_r", "left").drop("_r", "_l")
    m = sized(m.withColumn("_k", F.coalesce(F.concat(F.lit("r:"), F.lower("_repo")), F.concat(F.lit("k:"), keys.match_key(F.col("raw_value"))))), "open")
    reused = m.where("_old is not null").select("raw_value", "entity_type", "source_config", F.col("_old").alias("canonical_id"))
    new = m.where("_old is null")
    one = new.groupBy("entity_type", "_k").agg(F.min("raw_value").alias("raw_value"), F.min("_repo").alias("_repo"))

    # Orgs that models need: those of repos by id, those of other names by what their prefix resolves to.
    models = one.where("entity_type = 'model'").withColumn("_raw_org", F.when(F.col("_repo").isNotNull(), F.substring_index("_repo", "/", 1)).otherwise(_prefix(F.col("raw_value")))).withColumn("name", F.lower("_raw_org"))
    models = models.join(named.select("name", F.col("org").alias("_dev")), "name", "left").drop("name")
    models = sized(models, "models")
    asked = models.where("_repo is null and _raw_org is not null").select(F.col("_raw_org").alias("raw_value"), F.lit("org").alias("entity_type"), F.lit(None).cast("string").alias("source_config")).distinct()
    known = match.resolve(asked, aliases, mode="exact").where("canonical_id is not null").select(F.col("raw_value").alias("_raw_org"), F.col("canonical_id").alias("_org"))
    models = models.join(known, "_raw_org", "left")
    open_orgs = models.where("_repo is null and _raw_org is not null and _org is null").select(F.col("_raw_org").alias("raw_value")).distinct()
    orgs = one.where("entity_type = 'org'").select("_k", "raw_value").unionByName(open_orgs.select(F.concat(F.lit("k:"), keys.match_key(F.col("raw_value"))).alias("_k"), "raw_value"))
    orgs = orgs.groupBy("_k").agg(F.min("raw_value").alias("raw_value"))
    taken = entities.select("id", "entity_type", F.lit(True).alias("_t")).distinct()

    def free(df: DataFrame) -> DataFrame:
        """A hash behind ids that are taken, or wanted twice."""
        n = F.count("*").over(Window.partitionBy("id", "entity_type"))
        out = df.join(taken, ["id", "entity_type"], "left")
        return out.withColumn("id", F.when(F.col("_t") | (n > 1), F.concat("id", F.lit("-"), F.substring(F.sha2("raw_value", 256), 1, 6))).otherwise(F.col("id"))).drop("_t")

    orgs = sized(free(orgs.withColumn("entity_type", F.lit("org")).withColumn("id", keys.slug(F.col("raw_value")))), "orgs")
    draft_org = orgs.select("_k", F.col("id").alias("_new"))
    models = models.withColumn("_ok", F.when(F.col("_repo").isNull(), F.concat(F.lit("k:"), keys.match_key(F.col("_raw_org"))))).join(draft_org.withColumnRenamed("_k", "_ok"), "_ok", "left")
    org = F.when(F.col("_repo").isNotNull(), F.coalesce("_dev", "_raw_org")).otherwise(F.coalesce("_org", "_new"))
    shaped = keys.is_repo_id(F.col("raw_value"))
    models = models.withColumn("org_id", org).withColumn("id", F.coalesce("_repo", F.when(shaped, F.trim("raw_value")).otherwise(keys.slug(F.col("raw_value")))))
    models = sized(free(models.select("entity_type", "_k", "raw_value", "_repo", "org_id", "id")), "named")
    repo_orgs = models.where("_repo is not null").select(F.col("org_id").alias("id")).distinct().join(entities.where("entity_type = 'org'").select("id"), "id", "left_anti").join(orgs.select("id"), "id", "left_anti")

    # Edges, each kind only where the ones before leave room.
    forms = aliases.where("entity_type = 'model' and coalesce(status, '') <> 'rejected'").select(F.col("raw_value").alias("form"), "canonical_id").unionByName(entities.where("entity_type = 'model'").select(F.col("id").alias("form"), F.col("id").alias("canonical_id")))
    edge = lambda parent, relationship, axis: F.struct(parent.alias("id"), relationship.cast("string").alias("relationship"), F.lit(axis).cast("string").alias("axis"))
    if external is None:
        rows = models.select("*", F.lit(None).cast("string").alias("release_date"), F.lit(None).cast("double").alias("params_billions"), F.lit(None).cast("boolean").alias("open_weights"), F.array().cast(f"array<{EDGE}>").alias("_based"))
    else:
        index = forms.groupBy(keys.index_key(F.col("form")).alias("_i")).agg(F.min("canonical_id").alias("base"))
        bases = external.select(F.lower("id").alias("_l"), "relation", F.explode("base_models").alias("raw")).withColumn("_i", keys.index_key(F.col("raw"))).join(index, "_i").where("lower(base) <> _l")
        bases = bases.groupBy("_l").agg(F.array_sort(F.collect_set(edge(F.col("base"), F.coalesce("relation", F.lit("finetune")), None))).alias("_based"))
        facts = external.groupBy(F.lower("id").alias("_l")).agg(*(F.min_by(c, "id").alias(c) for c in ("release_date", "params_billions", "open_weights")))
        rows = models.withColumn("_l", F.lower("_repo")).join(facts, "_l", "left").join(bases, "_l", "left").withColumn("_based", F.coalesce("_based", F.array().cast(f"array<{EDGE}>"))).drop("_l")
    dated = match.infer_snapshot_edges(models.where(shaped).select(F.col("raw_value").alias("id")), forms).select(F.col("id").alias("raw_value"), F.col("parent").alias("_family"))
    rows = rows.join(dated, "raw_value", "left")
    has_version = F.exists("_based", lambda e: (e["relationship"] == "variant") & (e["axis"] == "version"))
    versioned = ~F.coalesce(has_version, F.lit(False)) & F.col("_family").isNotNull() & (F.col("_family") != F.col("id"))
    rows = sized(rows.withColumn("_based", F.when(versioned, F.array_append("_based", edge(F.col("_family"), F.lit("variant"), "version"))).otherwise(F.col("_based"))).drop("_family"), "edges")
    base = infer_base_by_token(rows.where("_repo is null and size(_based) = 0").select("id", "raw_value"), aliases, named)
    rows = rows.join(base, "id", "left").withColumn("parents", F.when(F.col("base").isNotNull(), F.array(edge(F.col("base"), F.lit("finetune"), None))).otherwise(F.col("_based")))

    found = F.col("_repo").isNotNull()
    none = F.lit(None).cast("string")
    made = rows.select(
        "id", "entity_type", F.when(found, F.regexp_replace("_repo", r"^[^/]*/", "")).otherwise(keys.display_name(F.col("raw_value"))).alias("display_name"), "org_id", none.alias("kind"), F.when(found, "reviewed").otherwise("draft").alias("review_status"),
        F.when(found, "hf").otherwise("inferred").alias("resolution_source"), F.when(~found, "variant").alias("resolution_granularity"),
        F.when(F.col("org_id").isNull(), F.array(F.lit("org-unknown"))).otherwise(F.array().cast("array<string>")).alias("tags"), "parents", "release_date", "params_billions", "open_weights", "_k",
    )

    def plain(df: DataFrame, kind: Column, status: str) -> DataFrame:
        return df.select(
            "id", "entity_type", F.col("raw_value").alias("display_name"), none.alias("org_id"), kind.alias("kind"), F.lit(status).alias("review_status"), none.alias("resolution_source"), none.alias("resolution_granularity"),
            F.array().cast("array<string>").alias("tags"), F.array().cast(f"array<{EDGE}>").alias("parents"), none.alias("release_date"), F.lit(None).cast("double").alias("params_billions"), F.lit(None).cast("boolean").alias("open_weights"), "_k",
        )

    others = free(one.where("entity_type not in ('model', 'org')").withColumn("id", keys.slug(F.col("raw_value"))))
    communities = repo_orgs.withColumn("entity_type", F.lit("org")).withColumn("raw_value", F.col("id")).withColumn("_k", none)
    drafts = sized(made.unionByName(plain(orgs, F.lit("unknown"), "draft")).unionByName(plain(communities, F.lit("community"), "reviewed")).unionByName(plain(others, none, "draft")), "drafts")
    spelled = new.select("raw_value", "entity_type", "source_config", "attested_id", "_k").unionByName(open_orgs.select("raw_value", F.lit("org").alias("entity_type"), none.alias("source_config"), none.alias("attested_id"), F.concat(F.lit("k:"), keys.match_key(F.col("raw_value"))).alias("_k"))).distinct()
    sure = F.col("attested_id").isNotNull()
    links = spelled.join(drafts.where("_k is not null").select("entity_type", "_k", F.col("id").alias("canonical_id")), ["entity_type", "_k"])
    links = links.select("raw_value", "entity_type", "source_config", "canonical_id", F.when(sure, "auto").otherwise("uncertain").alias("status"), F.when(sure, "attested").otherwise("auto").alias("strategy"))
    links = links.unionByName(reused.select("*", F.lit("auto").alias("status"), F.lit("attested").alias("strategy")))
    return {"drafts": drafts, "aliases": links.distinct(), "reused": reused}


# --- seeding aliases -------------------------------------------------------------------------------------------


def seed_by_rank(entities: DataFrame, orgs: DataFrame, org_map: DataFrame, scoped: DataFrame | None = None, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Aliases of entities by who has the better claim: ``aliases``, ``claims``, ``redirected``, ``shadowed``, ``changes``.

    ``entities``: entity_type, id, display_name, aliases, org_id, resolution_source, review_status, seq. ``orgs``: id, hf_org, display_name, aliases, kind, seq. ``scoped``:
    entity_type, id, raw_value, source_config. ``existing``: stored aliases, with status and canonical_id.

    Forms are id, name, aliases and scoped aliases. Of models only: a name that a lab has too, as name or alias, is no alias of others (``shadowed``), unless it is
    the id or listed; and a global form that is the last part of a confirmed model's id (a real repo or reviewed) goes to that model (``redirected``): a
    lab's takes it from all but other labs' models, the leaf's only confirmed one from unconfirmed models of no lab. Scoped forms stay as they are.

    A form that leads to two ids in the end is reported (``claims``: key, owners, declarers), not seeded. Against ``existing``, ``changes`` says what
    is new (``insert``) and which alias now leads elsewhere (``repoint``, with ``before``).
    """
    e = entities.withColumn("_p", F.when(F.col("id").contains("/"), F.substring_index("id", "/", 1))).withColumn("name", F.lower("_p"))
    spelled = orgs.select("id", "seq", F.posexplode(F.concat(F.array("id", "hf_org", "display_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_n", "_f")).where("_f is not null and _f <> ''")
    names = spelled.groupBy(F.lower("_f").alias("name")).agg(F.min_by("id", F.struct("seq", "_n")).alias("_named"))
    e = e.join(org_map.select("name", F.col("org").alias("_mapped")), "name", "left").join(names, "name", "left")
    e = e.withColumn("_dev", F.coalesce(F.nullif("org_id", F.lit("")), "_mapped", "_named", "_p")).join(orgs.select(F.col("id").alias("_dev"), (F.col("kind") == "lab").alias("_lab")).distinct(), "_dev", "left")
    model = F.col("entity_type") == "model"
    e = e.withColumn("_lab", model & F.coalesce("_lab", F.lit(False))).withColumn("_sure", model & F.col("id").contains("/") & (F.col("resolution_source").eqNullSafe("hf") | F.col("review_status").eqNullSafe("reviewed")))
    e = sized(e.select("entity_type", "id", "display_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "seq", "_dev", "_lab", "_sure"), "seeds")
    leaf = keys.match_key(F.regexp_replace("id", r"^[^/]*/", ""))
    sure = e.where("_sure").withColumn("_k", leaf)
    labs = sure.where("_lab").groupBy("_k").agg(F.min_by(F.struct("id", "_dev"), F.struct("seq", "id")).alias("_b")).select("_k", F.col("_b.id").alias("_lab_id"), F.col("_b._dev").alias("_lab_dev"))
    only = sure.groupBy("_k").agg(F.min("id").alias("_only"), F.max("id").alias("_m")).where("_only = _m").drop("_m")
    taken = e.where("_lab").select(F.explode(F.concat(F.array("display_name"), "aliases")).alias("_f")).where("_f is not null and _f <> ''").select(keys.match_key(F.col("_f")).alias("_k")).distinct().withColumn("_taken", F.lit(True))
    listed = F.array_distinct(F.filter(F.concat(F.array("id", "display_name"), "aliases"), lambda f: f.isNotNull() & (f != "")))
    forms = e.withColumn("raw_value", F.explode(listed)).withColumn("_k", keys.match_key(F.col("raw_value"))).join(taken, "_k", "left").join(labs, "_k", "left").join(only, "_k", "left")
    auto = (F.col("raw_value") == F.col("display_name")) & (F.col("raw_value") != F.col("id")) & ~F.array_contains("aliases", F.col("raw_value"))
    forms = forms.withColumn("_hidden", (F.col("entity_type") == "model") & auto & ~F.col("_lab") & F.coalesce("_taken", F.lit(False)))
    is_model = F.col("entity_type") == "model"
    to_lab = is_model & F.col("_lab_id").isNotNull() & (F.col("_lab_id") != F.col("id")) & (~F.col("_lab") | (F.col("_lab_dev") == F.col("_dev")))
    to_only = is_model & ~F.col("_lab") & ~F.col("_sure") & F.col("_only").isNotNull() & (F.col("_only") != F.col("id"))
    forms = sized(forms.withColumn("canonical_id", F.when(to_lab, F.col("_lab_id")).when(to_only, F.col("_only")).otherwise(F.col("id"))).select("entity_type", "raw_value", F.lit(None).cast("string").alias("source_config"), "canonical_id", F.nullif(F.col("id"), F.col("canonical_id")).alias("declared_by"), "_hidden"), "forms")
    released(e)
    # Most forms lead to who declares them, so only others are written.
    forms = forms.withColumn("declared_by", F.coalesce("declared_by", "canonical_id"))
    seen = forms.where("not _hidden").drop("_hidden")
    if scoped is not None:
        seen = seen.unionByName(scoped.where("raw_value is not null and raw_value <> ''").select("entity_type", "raw_value", F.nullif("source_config", F.lit("")).alias("source_config"), F.col("id").alias("canonical_id"), F.col("id").alias("declared_by")))
    key = ["entity_type", "raw_value", "source_config"]
    # Aliases, claims and changes all read these groups.
    grouped = sized(seen.groupBy(*key).agg(F.min("canonical_id").alias("canonical_id"), (F.min("canonical_id") == F.max("canonical_id")).alias("_one")), "grouped")
    ok = grouped.where("_one").drop("_one")
    double = grouped.where("not _one").select(*(F.col(c).alias(f"_{c}") for c in key))
    claims = seen.join(double, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]).groupBy(*key).agg(F.array_sort(F.collect_set("canonical_id")).alias("owners"), F.array_sort(F.collect_set("declared_by")).alias("declarers"))
    out = {"aliases": ok, "claims": claims, "redirected": forms.where("not _hidden and canonical_id <> declared_by").drop("_hidden", "source_config"), "shadowed": forms.where("_hidden").select("raw_value", "declared_by")}
    if existing is not None:
        live = existing.where(F.coalesce("status", F.lit("")) != "rejected").select("entity_type", "raw_value", F.coalesce("source_config", F.lit("")).alias("_s"), F.col("canonical_id").alias("before"))
        both = ok.withColumn("_s", F.coalesce("source_config", F.lit(""))).join(live, ["entity_type", "raw_value", "_s"], "left").drop("_s")
        what = F.when(F.col("before").isNull(), "insert").when(F.col("before") != F.col("canonical_id"), "repoint")
        out["changes"] = both.withColumn("change", what).where("change is not null")
    return out
