"""Personal data by bootstrapped contexts: what fixed patterns find are seeds, the words around seeds are lexical patterns, and
patterns that stand almost only around seeds of one kind find identifiers that no fixed pattern fits.

Everything is a DataFrame expression. One pass over the texts finds seeds and candidates (digit chains and addresses of a looser form)
with the words around them. Their graph of lexical patterns and distinct values is scored in rounds of two joins and two
aggregations; scores are whole millionths, so sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

#: Kinds in their order, and what a seed of each kind looks like. The look-behinds and possessive repeats keep the
#: matches of the plain patterns and make long runs linear: a run that fails from its first character fails from all others.
KINDS = ("email", "ip", "card", "phone")
SEEDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # The longest chain of digits with at most one space or hyphen between two, if it has 12 to 19.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What may turn out to be an identifier: an address without a dotted domain, or 7 to 19 digits with separators.
CANDIDATE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
    r"|(?<![A-Za-z0-9+])(?<![0-9][ ().-]{1,2})\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![ ().-]{0,2}[0-9])(?![A-Za-z])"
)
#: A text without a match of these has no match of the pattern; they cost less.
_QUICK = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]", "": r"@|[0-9](?:[ ().-]{0,2}[0-9]){6}"}
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters before and after a match in which its neighbouring words are looked for.
REACH = 80
ONE = 1_000_000


def _matches(text: Column, kind: str, regex: str) -> Column:
    """Each match with the length of the text since the match before, and the words next to it."""
    found, gaps = F.regexp_extract_all(text, F.lit(regex), 0), F.split(text, regex, -1)

    def one(k: Column) -> Column:
        gap, value = F.get(gaps, k), F.get(found, k)
        return F.struct(
            F.lit(kind).alias("kind"), k.alias("pos"), F.length(gap).cast("long").alias("gap"), F.length(value).cast("long").alias("size"), value.alias("value"),
            _words(F.substring(gap, -REACH, REACH)).alias("left"), F.get(_words(F.substring(F.get(gaps, k + 1), 1, REACH)), F.lit(0)).alias("right"),
        )

    struct = "array<struct<kind:string,pos:int,gap:long,size:long,value:string,left:array<string>,right:string>>"
    some = text.rlike(_QUICK[kind]) & (F.size(found) > 0)
    return F.when(some, F.transform(F.sequence(F.lit(0), F.size(found) - 1), one)).otherwise(F.array().cast(struct))


def _words(text: Column) -> Column:
    """Words in lower case (A-Z), every digit run as one 0."""
    return F.regexp_extract_all(F.regexp_replace(F.translate(text, UPPER, LOWER), "[0-9]+", "0"), F.lit(WORD), 0)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int") * (1 + k % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid() -> Column:
    """Whether a seed's match counts."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
    return (
        F.when(F.col("kind") == "ip", F.forall(F.split("value", r"\."), part))
        .when(F.col("kind") == "card", _luhn(digits))
        .when(F.col("kind") == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def _could_be(value: Column) -> Column:
    """For each kind, whether a candidate may be of it."""
    address, n = F.contains(value, F.lit("@")), F.length(F.regexp_replace(value, "[^0-9]", ""))
    return F.array(address, ~address & value.rlike(r"^[0-9]{1,3}([.-][0-9]{1,3}){3}$"), ~address & n.between(12, 19), ~address & n.between(7, 15))


def occurrences(found: DataFrame) -> DataFrame:
    """Seeds (valid ones) and candidates that touch no seed, one row each: _row, kind ('' for candidates), start, end, value, patterns.

    ``found`` has _row and ``_found``, the matches of all kinds. The lexical patterns are the two words before, and the word before
    with the word behind; where there is no word before there is none.
    """
    rows = found.where(F.size("_found") > 0).select("_row", F.explode("_found").alias("_m")).select("_row", "_m.*").repartition("_row")
    before = Window.partitionBy("_row", "kind").orderBy("pos")
    start = F.sum(F.col("gap") + F.col("size")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("start", start).withColumn("end", F.col("start") + F.col("size")).where((F.col("kind") == "") | _valid())
    # A seed that begins no later ends behind the start, or one that begins later begins before the end. Seeds sort before candidates.
    seed = F.col("kind") != ""
    at = Window.partitionBy("_row").orderBy("start", F.col("kind") == "")
    over = F.max(F.when(seed, F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    ahead = F.min(F.when(seed, F.col("start"))).over(at.rowsBetween(1, Window.unboundedFollowing)) < F.col("end")
    apart = placed.withColumn("_touch", F.coalesce(over, F.lit(False)) | F.coalesce(ahead, F.lit(False))).where(seed | ~F.col("_touch"))
    last, two = F.element_at("left", -1), F.array_join(F.slice("left", F.greatest(F.size("left") - 1, F.lit(1)), 2), " ")
    patterns = F.array_compact(F.array(F.concat(two, F.lit(" \n")), F.when(F.col("right").isNotNull(), F.concat(last, F.lit(" \n "), "right"))))
    none = F.array().cast("array<string>")
    return apart.select("_row", "kind", "start", "end", "value", F.when(F.size("left") > 0, patterns).otherwise(none).alias("patterns"))


def score_patterns(seen: DataFrame, rounds: int = 4) -> DataFrame:
    """Confidence of each lexical pattern for each kind: pattern, c (array of millionths by kind), mass (array: sum of scores).

    A seed's score is one for its kind. A pattern's confidence is the sum of the scores of its distinct values over their number
    and one; a candidate's score is the mean confidence of its patterns, for the kinds that it could be. Both are found in turn.
    """
    edges = seen.select("kind", F.lower("value").alias("value"), F.explode("patterns").alias("pattern")).distinct()
    sure = F.array(*(F.when(F.col("kind") == k, ONE).otherwise(0).cast("long") for k in KINDS))
    edges = stored(edges.withColumn("sure", sure).withColumn("open", F.when(F.col("kind") == "", _could_be(F.col("value")))), "edges")

    def weigh(scored: DataFrame) -> DataFrame:
        sums = scored.groupBy("pattern").agg(F.count("*").alias("n"), *(F.sum(F.get("score", F.lit(k))).alias(f"s{k}") for k in range(len(KINDS))))
        mass = F.array(*(F.col(f"s{k}") for k in range(len(KINDS))))
        return sums.select("pattern", F.transform(mass, lambda s: F.floor(s / (F.col("n") + 1)).cast("long")).alias("c"), mass.alias("mass"))

    weights = stored(weigh(edges.withColumn("score", F.col("sure"))), "weights")
    candidates = edges.where("kind = ''").select("value", "open", "pattern")
    for _ in range(rounds - 1):
        means = candidates.join(weights, "pattern").groupBy("value").agg(F.first("open").alias("open"), F.count("*").alias("n"), *(F.sum(F.get("c", F.lit(k))).alias(f"s{k}") for k in range(len(KINDS))))
        score = F.array(*(F.when(F.get("open", F.lit(k)), F.floor(F.col(f"s{k}") / F.col("n")).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(len(KINDS))))
        known = candidates.select("value", "pattern").join(means.select("value", score.alias("score")), "value").select("pattern", "score")
        seeds = edges.where("kind <> ''").select("pattern", F.col("sure").alias("score"))
        weights = stored(weigh(seeds.unionByName(known)), "weights")
    return weights


def discover(seen: DataFrame, weights: DataFrame, confidence: int = 750_000, support: int = 5) -> DataFrame:
    """Candidates next to a confident pattern: _row, kind, start, end. The most confident pattern decides, then the kinds' order.

    A pattern counts for a kind from ``confidence`` millionths on, if the scores of its values sum to ``support``.
    """
    good = F.transform(F.arrays_zip("c", "mass"), lambda x: F.when((x["c"] >= confidence) & (x["mass"] >= support * ONE), x["c"]))
    trusted = weights.withColumn("c", good).where(F.exists("c", lambda x: x.isNotNull())).select("pattern", "c")
    open_ = seen.where("kind = ''").withColumn("open", _could_be(F.col("value"))).select("_row", "start", "end", "open", F.explode("patterns").alias("pattern"))
    hits = open_.join(trusted, "pattern").select("_row", "start", "end", F.posexplode(F.arrays_zip("open", "c")).alias("k", "x"))
    hits = hits.where("x.open and x.c is not null")
    best = hits.groupBy("_row", "start", "end").agg(F.max(F.struct("x.c", (-F.col("k")).alias("k"))).alias("b"))
    names = F.array(*(F.lit(k) for k in KINDS))
    return best.select("_row", F.get(names, -F.col("b.k")).alias("kind"), "start", "end")


def find_private(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), rounds: int = 4, confidence: int = 750_000, support: int = 5) -> DataFrame:
    """The ``carry`` columns of each row with ``base`` and ``added``: spans (kind, start, end; code points, end exclusive) by start, then kind.

    ``base`` has what the fixed patterns find, ``added`` what confident contexts find besides; no added span touches a base span.
    A null text counts as empty; an empty table gives an empty result. Rows are judged each for itself, repeated ones and those
    that share a doc_id too; copies of a text add nothing to a pattern's score, as distinct values count. Columns not carried,
    whatever their names, are ignored. All work on a text is linear in its length. Rows are told apart by
    ``monotonically_increasing_id``, so the input should be a scan or a stored table.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*carry).alias("_carry"), body.alias("_text"))
    parts = [_matches(F.col("_text"), kind, regex) for kind, regex in [*SEEDS.items(), ("", CANDIDATE)]]
    found = stored(rows.select("_row", "_carry", F.concat(*parts).alias("_found")), "found")
    seen = stored(occurrences(found), "occurrences")
    added = discover(seen, score_patterns(seen, rounds), confidence, support).withColumn("base", F.lit(False))
    spans = seen.where("kind <> ''").select("_row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added)
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    span = F.struct("start", order.alias("k"), "end", "kind")
    lists = spans.groupBy("_row").agg(*(F.array_sort(F.collect_list(F.when(c, span))).alias(name) for name, c in (("base", F.col("base")), ("added", ~F.col("base")))))
    plain = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<start:long,k:long,end:long,kind:string>>")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select("_row", "_carry").join(lists, "_row", "left").select("_carry.*", plain(F.col("base")).alias("base"), plain(F.col("added")).alias("added"))


def spell(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, by start and then kind."""
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(names, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "<{}>") -> DataFrame:
    """``text`` with each span of ``spans`` (kind, start, end) replaced by its kind's mark; of spans that overlap the first counts.

    Spans must be in order of start. A null text stays null; without spans a text stays as it is.
    """
    init = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        named = F.concat(F.lit(mark.split("{}")[0]), s["kind"], F.lit(mark.split("{}")[1]))
        return F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.array(piece, named)).alias("out"), s["end"].alias("at"))).otherwise(acc)

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text)))
    return df.withColumn(text, F.aggregate(F.col(spans), init, step, rest))
