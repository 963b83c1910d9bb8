"""Match keys and other derived columns: each function takes and returns Columns.

All patterns are Unicode-aware (``(?U)``), so that accented letters count as letters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

#: Org parts that stand for a missing developer.
PLACEHOLDER_ORGS = ("unknown", "none", "na", "")
#: Name parts that say how a benchmark was run.
RUN_CONFIG_TOKENS = ("cot", "zeroshot", "fewshot", "0shot", "flan", "gen")
#: Metric phrases (patterns over lower-case text) and their names, in order of preference at one place.
METRIC_RULES = [
    (r"pass@10(?!\d)", "Pass@10"), (r"pass@8(?!\d)", "Pass@8"), (r"pass@1(?!\d)", "Pass@1"),
    (r"pass[\s_-]*at[\s_-]*10(?!\d)", "Pass@10"), (r"pass[\s_-]*at[\s_-]*8(?!\d)", "Pass@8"), (r"pass[\s_-]*at[\s_-]*1(?!\d)", "Pass@1"),
    (r"mean[\s_-]*win[\s_-]*rate", "Mean Win Rate"), (r"win[\s_-]*rate", "Win Rate"),
    (r"mean[\s_-]*response[\s_-]*time", "Mean Response Time"), (r"mean[\s_-]*score", "Mean Score"),
    (r"exact[\s_-]*match", "Exact Match"), (r"bleu[\s_-]*4", "BLEU-4"), (r"cot[\s_-]*correct", "COT correct"),
    (r"wb[\s_-]*score", "WB Score"), (r"avg[\s_-]*attempts", "Average Attempts"), (r"latency[\s_-]*mean", "mean-latency"),
    (r"latency.*(?:p95|95th)", "p95-latency"), (r"latency.*(?:std|standard)", "latency-stddev"), (r"max[\s_-]*delta", "max-delta"),
    (r"benchmark\s+evaluation", "score"), (r"outperform", "rank"), (r"ast[\s_-]*accuracy", "AST Accuracy"),
    (r"normali[sz]ed[\s_-]*accuracy", "Normalized Accuracy"), (r"overall[\s_-]*accuracy", "Accuracy"),
    (r"(?:ir)?relevance[\s_-]*detection[\s_-]*accuracy", "Accuracy"), (r"no[\s_-]*snippet[\s_-]*accuracy", "Accuracy"),
    (r"long[\s_-]*context[\s_-]*accuracy", "Accuracy"), (r"kv[\s_-]*accuracy", "Accuracy"), (r"vector[\s_-]*accuracy", "Accuracy"),
    (r"recursive[\s_-]*summarization[\s_-]*accuracy", "Accuracy"), (r"total[\s_-]*cost", "cost"), (r"cost[\s_-]*per[\s_-]*task", "cost-per-task"),
    (r"\baccuracy\b", "Accuracy"), (r"\bacc\b", "Accuracy"), (r"\bscores?\b", "score"), (r"\bf1\b", "F1"), (r"\bem\b", "Exact Match"),
    (r"\belo\b", "Elo Rating"), (r"\branks?\b", "rank"), (r"\bcosts?\b", "cost"), (r"\bharmlessness\b", "harmlessness"), (r"\bstddev\b", "stddev"),
]
#: Metric words at the end of a benchmark name, the first that fits decides.
TRAILING_METRICS = [
    r"mean\s+win\s+rate$", r"mean\s+response\s+time$", r"mean\s+score$", r"win\s+rate$", r"avg\s+attempts$", r"avg\s+latency\s+ms$",
    r"cost\s+per\s+\d+\s+calls\s+usd$", r"cost\s+per\s+task$", r"pass@\d+$", r"\b(?:score|accuracy|acc|elo|rank|f1|em)$",
]


#: Suffix tokens of model names and the edge each stands for (relationship, axis).
SEGMENT_KINDS: dict[str, tuple[str, str | None]] = {
    **dict.fromkeys(("instruct", "it", "chat", "base", "pt", "sft"), ("variant", "training_stage")),
    **dict.fromkeys(("haiku", "sonnet", "opus", "mini", "nano", "micro", "flash", "pro", "small", "medium", "large", "lite"), ("variant", "tier")),
    **dict.fromkeys(("thinking", "reasoning", "nothink", "guard", "safeguard", "moderation"), ("variant", "mode")),
    **dict.fromkeys(("vision", "vl"), ("variant", "modality")),
    **dict.fromkeys(("coder", "code", "math"), ("variant", "domain")),
    **dict.fromkeys(("turbo", "fp8", "fp16", "bf16", "int4", "int8", "awq", "gptq", "gguf"), ("quantized", None)),
}


@dataclass(frozen=True)
class CatalogueRules:
    """Rule tables of catalogue ids; the defaults are fixed values. ``paths`` and ``prefixes`` are patterns, tried once each in order.

    ``stamps`` are patterns of the words that are dates wherever they stand; a catalogue whose numbers are serial ones has none.
    """

    paths: tuple[str, ...] = ("accounts/[^/]+/models/", "hf:", "@cf/", "clarifai/[^/]+/models/", "route/", "orcarouter/")
    prefixes: tuple[str, ...] = ("databricks-", "azure-", "aws-", "openai-", "anthropic-", "ai21-", "stealth/")
    regions: tuple[str, ...] = ("us", "eu", "jp", "au", "apac", "global")
    hosts: tuple[str, ...] = ("amazon", "anthropic", "qwen", "meta", "google", "cohere", "ai21", "deepseek", "mistral")
    serving: tuple[str, ...] = ("fast", "precision", "free", "maas", "tee")
    variants: tuple[str, ...] = ("thinking", "think", "reasoner", "reasoning", "turbo", "fp8", "bf16", "int8", "awq", "gptq")
    stamps: tuple[str, ...] = (r"\d{8}", r"\d{6}")


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, "(?U)" + pattern, to)


def match_key(c: Column) -> Column:
    """Lower case; a dot between digits is a space; punctuation but ``+ - / _`` goes; separators collapse."""
    c = _sub(F.trim(F.lower(c)), r"(?<=\d)\.(?=\d)", " ")
    return F.trim(_sub(_sub(c, r"[^\w\s\-/+]", ""), r"[\s_\-/]+", " "))


def index_key(c: Column) -> Column:
    """Lower case; runs of ``/ _ . : -`` are one dash, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[/_.:-]+", "-"), F.lit("-"))


def collision_key(c: Column) -> Column:
    """Lower case without separators; a placeholder org in front is dropped."""
    low = F.lower(c)
    org = F.when(F.instr(low, "/") > 0, F.trim(F.substring_index(low, "/", 1)))
    body = F.when(org.isin(*PLACEHOLDER_ORGS), F.regexp_replace(low, r"^[^/]*/", "")).otherwise(low)
    return F.regexp_replace(body, r"[-_./]", "")


def size_signature(c: Column) -> Column:
    """The sizes (numbers before ``b``) in a name, in order of size."""
    return F.array_sort(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\d+(?:\.\d+)?)b"), F.lit(1)), lambda x: x.cast("double")))


def name_key(c: Column) -> Column:
    """The match key as one word."""
    return F.replace(match_key(c), F.lit(" "), F.lit(""))


def org_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def strict_key(c: Column) -> Column:
    """Letters and digits only, without accents and case.

    Latin letters with marks are spelled out by a table; composed letters outside it stay as they are, and
    marks that stand alone go.
    """
    marked = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
    plain = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
    low = F.replace(F.translate(F.lower(c), marked, plain), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(low, r"[^\p{L}\p{N}]", "")


def signature(key: Column) -> Column:
    """Words in sorted order, then numbers in their own order."""
    parts = F.filter(F.split(key, r"[\s\-_./:]+"), lambda x: x != "")
    number = lambda x: x.rlike(r"^\d+$")
    return F.concat_ws(" ", F.array_sort(F.filter(parts, lambda x: ~number(x))), F.filter(parts, number))


def catalogue_name(c: Column, rules: CatalogueRules | None = None, variants: bool = True) -> Column:
    """A provider's model id as a name: without account paths, hosts, regions and serving tags, in lower case with dashes.

    ``variants`` also drops tails that name a variant (grouping wants that, aliases don't). A size behind a colon stays.
    """
    r = rules or CatalogueRules()
    hosted = lambda x: F.regexp_replace(x, "^(?:(?:" + _quoted([*r.regions, *r.hosts]) + ")[.])+", "")
    tails = "|".join([*r.serving, *(r.variants if variants else ())])
    out = F.regexp_replace(F.trim(c), "^~+", "")
    out = F.regexp_replace(out, "^" + "".join(f"(?:{x})?" for x in r.paths), "")
    out = F.regexp_replace(F.replace(out, F.lit("--"), F.lit("/")), "^" + "".join(f"(?:{x})?" for x in r.prefixes), "")
    out = F.lower(hosted(F.regexp_replace(hosted(out), "(?s)^.*/", "")))
    out = F.regexp_replace(F.replace(out, F.lit("@default"), F.lit("")), r"@(\d{8})$", "-$1")
    out = F.regexp_replace(F.regexp_replace(out, "@.*$", ""), r"-v\d+:\d+$", "")
    out = F.regexp_replace(out, r":(\d+(?:\.\d+)?[bmkt])$", "-$1")
    out = F.regexp_replace(out, f"(?::.*|-(?:{tails}))+$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(\d)\.(\d)", "$1-$2"), r"[_\s]+", "-")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"\(.*$", ""), "-+", "-"), F.lit("-"))


def catalogue_key(c: Column, rules: CatalogueRules | None = None) -> Column:
    """The model behind a provider's id: its catalogue name without ``latest`` (``old``, ``new``), dates and a trailing ``vN``."""
    out = F.regexp_replace(catalogue_name(c, rules), "-(?:latest|old|new)$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"-\d{4}-\d{2}-\d{2}$", ""), r"-\d{2}-\d{2}$", "")
    stamps = (rules or CatalogueRules()).stamps
    if stamps:
        out = F.array_join(F.filter(F.split(out, "-"), lambda w: ~w.rlike("^(?:" + "|".join(stamps) + ")$")), "-")
    return F.regexp_replace(out, r"(?:^|-)v\d+$", "")


def catalogue_signature(key: Column) -> Column:
    """A catalogue key's words in sorted order, then its numbers (with a letter at most) in their own."""
    parts = F.split(key, "-")
    number = lambda w: w.rlike(r"^\d+[a-z]?$")
    return F.concat(F.array_join(F.array_sort(F.filter(parts, lambda w: ~number(w))), "|"), F.lit("#"), F.array_join(F.filter(parts, number), "-"))


def suffix_segments(c: Column, kinds: dict[str, tuple[str, str | None]] | None = None) -> Column:
    """The parts of a name behind its family, left to right: an array of (token, relationship, axis).

    Dots and underscores separate as dashes do. A date and ``vN-N`` are one token each; from the first unknown token on,
    the rest is one version.
    """
    kinds = SEGMENT_KINDS if kinds is None else kinds
    size = r"\d+b|\d+x\d+b|a\d+b"
    whole = "|".join([r"\d{4}-\d{2}-\d{2}", r"v\d+-\d+", r"\d{4}-\d{2}", r"v\d+", r"\d{8}", r"\d{3,4}", size, _quoted(list(kinds))])
    norm = F.btrim(F.regexp_replace(F.lower(c), "[._]+", "-"), F.lit("-"))
    found = F.regexp_extract_all(norm, F.lit(rf"\G-?((?:{whole})(?=-|$)|.+)"), F.lit(1))
    edge = lambda r, a: F.struct(F.lit(r).cast("string").alias("relationship"), F.lit(a).cast("string").alias("axis"))
    table = F.create_map(*(x for k, (r, a) in kinds.items() for x in (F.lit(k), edge(r, a))))

    def typed(w: Column) -> Column:
        e = F.coalesce(F.try_element_at(table, w), F.when(w.rlike(f"^(?:{size})$"), edge("variant", "size")), edge("variant", "version"))
        return F.struct(w.alias("token"), e["relationship"].alias("relationship"), e["axis"].alias("axis"))

    return F.transform(found, typed)


def family_slug(c: Column) -> Column:
    """A name without stacked date, preview, latest, version and stage tails."""
    return F.regexp_replace(F.lower(c), r"(?:[-_](?:\d{8}|\d{6}|\d{4}-\d{2}(?:-\d{2})?|\d{2}-\d{2}|preview|latest|exp|experimental|beta|alpha|v\d+))+$", "")


def slug(c: Column) -> Column:
    """Letters, digits, dots and single dashes; a blank name gets ``auto-`` and a hash, the same on every run."""
    out = F.btrim(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9.]+", "-"), F.lit("-"))
    return F.when(F.coalesce(out, F.lit("")) == "", F.concat(F.lit("auto-"), F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 8))).otherwise(out)


def is_repo_id(c: Column) -> Column:
    """Exactly one ``/`` with something on both sides."""
    return F.coalesce(c.rlike(r"^[^/]*[^/\s][^/]*/[^/]*[^/\s][^/]*$"), F.lit(False))


def id_date(c: Column) -> Column:
    """The release date in an id's tail as YYYY-MM-DD; the first shape that fits decides, even if out of range."""
    shapes = [(r"-(\d{4})-(\d{2})-(\d{2})$", True), (r"-(\d{4})(\d{2})(\d{2})$", True), (r"-(\d{4})-(\d{2})$", False)]
    out = F.lit(None).cast("string")
    for pattern, day in reversed(shapes):
        parts = [F.regexp_extract(c, pattern, k) for k in range(1, 4 if day else 3)]
        number = [x.try_cast("int") for x in parts]
        good = number[0].between(2015, 2035) & number[1].between(1, 12)
        if day:
            good = good & number[2].between(1, 31)
        date = F.concat_ws("-", *parts, *([] if day else [F.lit("01")]))
        out = F.when(c.rlike(pattern), F.when(good, date)).otherwise(out)
    return out


def metric_phrase(c: Column, rules: Sequence[tuple[str, str]] = METRIC_RULES) -> Column:
    """A metric's name out of a description; the keyword that comes first wins, earlier rules on ties."""
    text = F.trim(c)
    dotted = text.contains(".") & ~text.contains(" ")
    tail = F.trim(F.replace(F.substring_index(text, ".", -1), F.lit("_"), F.lit(" ")))
    before = F.regexp_extract(text, r"(?is)^(.+?)\s+on\s+\S+", 1)
    words = lambda x: F.size(F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != ""))
    short = F.when((before != "") & (words(before) <= 3), F.trim(before)).otherwise(text)
    text = F.when(dotted, tail).otherwise(short)
    low = F.lower(text)
    places = [F.struct((F.regexp_instr(low, F.lit(p))).alias("at"), F.lit(k).alias("rule"), F.lit(name).alias("name")) for k, (p, name) in enumerate(rules)]
    found = F.array_min(F.filter(F.array(*places), lambda x: x["at"] > 0))["name"]
    found = F.when(dotted | (words(text) > 1), found)
    return F.coalesce(found, F.when(~dotted & (words(text) > 3), F.lit("score")), text)


def clean_name(c: Column, trailing: Sequence[str] = TRAILING_METRICS) -> Column:
    """A benchmark's name without the metric: all but the last dotted part, or without trailing metric words."""
    text = F.trim(c)
    dotted = text.contains(".") & ~text.contains(" ")
    front = F.replace(F.replace(F.regexp_replace(text, r"\.[^.]*$", ""), F.lit("."), F.lit(" ")), F.lit("_"), F.lit(" "))
    spaced = F.when(text.contains("_") & ~text.contains(" "), F.replace(text, F.lit("_"), F.lit(" "))).otherwise(text)
    out = text
    for pattern in reversed(trailing):
        at = F.regexp_instr(F.lower(spaced), F.lit(pattern))
        prefix = F.trim(F.substring(spaced, F.lit(1), at - 1))
        out = F.when(at > 0, F.when(prefix != "", prefix).otherwise(text)).otherwise(out)
    return F.when(dotted, front).otherwise(out)


def name_segments(c: Column) -> Column:
    """Parts of a dotted name without blanks, numbers, ``overall`` and adjacent repeats; null if there are none."""
    text = F.trim(c)
    parts = F.filter(F.transform(F.split(text, r"\."), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^\d+$") & (F.lower(p) != "overall"))
    kept = F.filter(parts, lambda p, k: (k == 0) | (F.lower(p) != F.lower(F.get(parts, k - 1))))
    return F.when(text.contains(".") & ~text.contains(" ") & (F.size(kept) > 0), kept)


def without_run_config(c: Column, tokens: Sequence[str] = RUN_CONFIG_TOKENS) -> Column:
    """A benchmark's name without tokens of run configuration; null if nothing goes or nothing is left."""
    parts = F.split(F.trim(c), r"[\s_\-]+")
    kept = F.filter(parts, lambda p: ~F.lower(p).isin(*tokens) & ~F.lower(p).rlike(r"^\d+shot$"))
    return F.when((F.size(kept) > 0) & (F.size(kept) < F.size(parts)), F.concat_ws(" ", kept))


def snapshot_stems(c: Column) -> Column:
    """Names of the families a dated snapshot may belong to, most specific first."""
    cut = lambda pattern: F.when(c.rlike(pattern), F.regexp_replace(c, pattern, ""))
    inner = F.when(c.rlike(r"-(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])-"), F.regexp_replace(c, r"-(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?=-)", ""))
    stems = [inner, cut(r"(?<=-\d{4}-\d{2})-\d{2}$"), cut(r"(?<=-\d{4})-\d{2}(?:-\d{2})?$"), cut(r"-\d{4}-\d{2}(?:-\d{2})?$"), cut(r"-20\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])$"), cut(r"-20\d{2}(?:0[1-9]|1[0-2])$"), cut(r"-(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])$")]
    return F.array_distinct(F.filter(F.array(*stems), lambda x: x.isNotNull() & (x != "")))


def display_name(c: Column, acronyms: Sequence[str] = ("gpt", "glm", "ai", "llm", "moe", "vl", "hf")) -> Column:
    """A readable name: a name with a space stays; else the body's words, sizes and acronyms in capitals, a date in brackets."""
    body = F.regexp_replace(c, r"^.*/", "")
    dated = r"-(\d{4}-\d{2}-\d{2}|\d{8})$"
    date = F.regexp_extract(body, dated, 1)
    words = F.filter(F.split(F.regexp_replace(body, dated, ""), r"[-_\s]+"), lambda w: w != "")
    shown = F.transform(words, lambda w: F.when(F.lower(w).isin(*acronyms) | w.rlike(r"(?i)^\d+(?:\.\d+)?[bmk]$"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))))
    out = F.concat(F.concat_ws(" ", shown), F.when(date != "", F.concat(F.lit(" ("), date, F.lit(")"))).otherwise(F.lit("")))
    return F.when(c.contains(" "), c).otherwise(out)


def surface_forms(raw: Column, key: Column, org: Column) -> Column:
    """The spellings a provider's row is known by: raw, cleaned, its last part, and that under the org."""
    leaf = F.regexp_replace(key, r"^.*/", "")
    forms = F.array(raw, F.lower(raw), key, leaf, F.concat_ws("/", org, leaf))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "") & (F.length(x) - F.length(F.replace(x, F.lit("/"), F.lit(""))) <= 1)))


def twin_keys(c: Column) -> Column:
    """Keys under which two spellings of one model meet: with and without its org, and in word order."""
    key, leaf = match_key(c), match_key(F.regexp_replace(c, r"^[^/]*/", ""))
    return F.array_distinct(F.array(F.concat(F.lit("n:"), key), F.concat(F.lit("l:"), leaf), F.concat(F.lit("s:"), signature(leaf))))


@dataclass(frozen=True)
class FuzzyRules:
    """Rule tables of the fuzzy stage; platforms are captured beside the candidate, never in it."""

    suffixes: tuple[str, ...] = ()
    suffix_patterns: tuple[str, ...] = (r"-thinking-\d+k",)
    platform_suffixes: dict[str, str | None] = field(default_factory=dict)
    host_prefixes: dict[str, str | None] = field(default_factory=dict)
    org_aliases: dict[str, str] = field(default_factory=dict)


def _quoted(words: Sequence[str]) -> str:
    return "|".join(r"\Q" + w + r"\E" for w in sorted(words, key=len, reverse=True))


def _when_some(c: Column) -> Column:
    return F.when(c != "", c)


def _pick(table: dict, key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, F.lit(v).cast("string")).otherwise(out)
    return out


def fuzzy_steps(raw: str, rules: FuzzyRules) -> list[tuple[str, Callable[[Column], Column] | Column]]:
    """The steps that build candidates, as (kind, value): ``start`` arrays, then ``each`` functions to arrays.

    Every ``each`` applies to the raw value and all candidates so far, and appends what it gives.
    """
    tails = "|".join(x for x in (_quoted(rules.suffixes), *rules.suffix_patterns) if x)
    stem = lambda c: _when_some(F.regexp_extract(c, f"(?is)^(.*?)(?:{tails})$", 1)) if tails else F.lit(None).cast("string")
    some = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    c = F.col(raw)
    start = [some(_when_some(F.regexp_extract(c, r"(?is)^(.*-thinking)-\d+k$", 1)))]
    if rules.platform_suffixes:
        bare = _when_some(F.regexp_extract(c, f"(?is)^(.*?)(?:{_quoted(list(rules.platform_suffixes))})$", 1))
        start.append(some(bare, stem(bare)))
    start.append(some(stem(c), stem(stem(c))))

    def host(v: Column) -> Column:
        names = _quoted(list(rules.host_prefixes))
        bare = _when_some(F.regexp_extract(v, f"(?is)^(?:{names})[/](.+)$", 1))
        bare = F.coalesce(bare, _when_some(F.regexp_extract(v, f"(?is)^(?:{names})[.](.+)$", 1)))
        return some(bare, stem(bare))

    def once(v: Column) -> Column:
        slashed = r"(?is)^([^/\-]+)/\1(?:[/]|[-_])(.+)$"
        slugged = r"(?is)^((?:(?!__)[^\-])+)__\1(?:__|[-_])(.+)$"
        joined = lambda p, sep: F.when(v.rlike(p), F.concat(F.regexp_extract(v, p, 1), F.lit(sep), F.regexp_extract(v, p, 2)))
        return some(F.coalesce(joined(slashed, "/"), joined(slugged, "__")))

    def org(v: Column) -> Column:
        known = _pick(rules.org_aliases, F.lower(F.substring_index(v, "/", 1)))
        return some(F.when(v.contains("/"), F.concat(known, F.lit("/"), F.regexp_replace(v, "(?s)^[^/]*/", ""))))

    def joined(v: Column) -> Column:
        out = F.regexp_replace(v, r"([a-zA-Z])-(\d)", "$1$2")
        return some(F.when(out != v, out))

    def peeled(v: Column) -> Column:
        shaped = F.lower(v).startswith("openai/") | F.regexp_replace(v, "(?s)^[^/]*/", "").rlike(r"(?i)^(?:gpt|chatgpt|o\d|davinci|babbage|curie|ada)(?:-|$)")
        full, month = r"^(.+)-(20(?:1[5-9]|2\d|3[0-5]))-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$", r"^(.+)-(20(?:1[5-9]|2\d|3[0-5]))-(0[1-9]|1[0-2])$"
        part = lambda p, k: F.regexp_extract(v, p, k)
        days = F.array(F.concat_ws("-", part(full, 1), part(full, 2), part(full, 3)), F.concat_ws("-", part(full, 1), part(full, 2)))
        months = F.array(F.concat_ws("-", part(month, 1), part(month, 2)))
        return F.when(shaped & v.rlike(full), days).when(shaped & v.rlike(month), months).otherwise(F.array().cast("array<string>"))

    steps = [("start", F.concat(*start))]
    if rules.host_prefixes:
        steps.append(("each", host))
    steps.append(("each", once))
    if rules.org_aliases:
        steps.append(("each", org))
    return steps + [("each", joined), ("each", peeled)]


def captured_platform(raw: str, candidates: str, rules: FuzzyRules) -> Column:
    """The platform a mention names: by its suffix, else by the first host prefix that has one."""
    c = F.lower(F.col(raw))
    out = F.lit(None).cast("string")
    for suffix, platform in reversed(list(rules.platform_suffixes.items())):
        out = F.when(c.endswith(suffix), F.lit(platform).cast("string")).otherwise(out)
    hosts = F.transform(F.concat(F.array(F.col(raw)), F.col(candidates)), lambda v: _pick(rules.host_prefixes, F.lower(F.regexp_extract(v, r"(?s)^([^/.]+)[/.].", 1))))
    return F.coalesce(out, F.get(F.filter(hosts, lambda x: x.isNotNull()), F.lit(0)))
