"""One query for each operator of this subpackage, with its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, byte_bpe, filter_audit, lexical, minhash, packing, private_data, quality, sharding, substrings, token_counts, url_filter, warc
from .common import table

SHARDS, SEED = 24, 20240
#: The rules that the URL query judges by.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"
PACK_RANKS = "byte_bpe_50k.tiktoken"
#: The special token of the tokenizer that packing uses, and its id.
PACK_SPECIAL = {"<|endoftext|>": 50256}


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.assign_shards(slim, ["doc_id"], SHARDS, SEED)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("payload")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    coded = byte_bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    coded = coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return byte_bpe.decode_ids(coded, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    keys = ["lang", "source"]
    stats = quality.stored(quality.with_statistics(docs), "statistics")
    judged = quality.judge(stats, quality.fit(stats, keys), keys)
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECE_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS rules(host, path, action)")
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.cut_pieces(docs, public_tokenizers.path(PACK_RANKS), public_tokenizers.PATTERN, PACK_SPECIAL)
    slim = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.assign_sequences(slim, packing.groups_for(docs.count()), SEED)


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.array_compact(F.transform("base", _is(kind)))).cast("long").alias(f"n_{kind}") for kind in private_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(private_data.spell(F.col("base")), 256).alias("base_sha256"), private_data.spell(F.concat("base", "added")).alias("spans"))


def _is(kind: str):
    return lambda span: F.when(span["kind"] == kind, True)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), 50)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = filter_audit.document_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(failures, "ABCDE", flags=("good", "toxic"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_nearest, op3_warc, op4_near_duplicates, op5_byte_bpe, op6_quality, op7_token_counts, op8_url_filter, op9_substrings, op10_packing, op11_private_data, op12_ranked_search, op13_filter_audit)}


WORD = r"[^\x20\x09-\x0D]+"


def _crc32_sql(digits: str) -> str:
    """CRC-32 in SQL of the bytes that a column of hex digits spells: what the low byte adds is the sum of what its bits add."""
    poly = 0xEDB88320
    term = "0"
    for bit in range(8):
        n = 1 << bit
        for _ in range(8):
            n = n >> 1 ^ (poly if n & 1 else 0)
        term = f"xor({term}, ((xor(c, b) >> {bit}) & 1) * {n})"
    values = f"list_transform(range(1, length({digits}) // 2 + 1), lambda i: ('0x' || substr({digits}, 2 * i - 1, 2))::BIGINT)"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: xor(c >> 8, {term}))"
    return f"xor({fold}, 4294967295)"


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(map(str, RULES))
    bits = "substr(sha1(coalesce(html, '')), 1, 40)"
    # Hex digits become letters first, so that the bits put in their place are not read again.
    bits = f"translate({bits}, '0123456789abcdef', 'GHIJKLMNOPQRSTUV')"
    for k, letter in enumerate("GHIJKLMNOPQRSTUV"):
        bits = f"replace({bits}, '{letter}', '{k:04b}')"
    value = " + ".join(f"{1 << (4 - j)} * substr(bits, 5 * k + {j + 1}, 1)::INT" for j in range(5))
    base32 = f"array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({value}) + 1, 1)), '')"
    return {
        "op1_sharding": f"""
            WITH RECURSIVE numbered AS (
                SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, row_number() OVER (ORDER BY doc_id) - 1 AS row_number, count(*) OVER () AS n FROM documents),
            sized AS (SELECT *, greatest(1, (length(bin(greatest(1, n - 1))) + 1) // 2) AS w FROM numbered),
            {sharding.position_sql("sized", SEED)},
            placed AS (SELECT row_number, x FROM walk WHERE x < n)
            SELECT doc_id, length(digits) // 2 + 8 AS size, {_crc32_sql("digits")} AS text_crc32,
                'rows' AS law, (x % {SHARDS})::INT AS shard, x // {SHARDS} AS slot, NULL::INT AS grown_shard
            FROM sized JOIN placed USING (row_number)""",
        "op3_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS html, {bits} AS bits FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
            SELECT page_id, octet_length(encode(html)) AS payload_bytes, {base32} AS payload_digest,
                CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
        "op4_near_duplicates": rf"""
            WITH RECURSIVE w AS MATERIALIZED (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
            s AS MATERIALIZED (
                SELECT DISTINCT doc_id, hash(array_to_string(words[k:k + 4], ' ')) AS shingle FROM (
                    SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM w WHERE len(words) > 0)),
            c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
            link AS MATERIALIZED (
                SELECT a, b FROM common JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
            edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
            reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reach JOIN edge ON other = a),
            least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
            SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
            FROM documents d JOIN least USING (doc_id) LEFT JOIN c USING (doc_id)""",
        "op8_url_filter": rf"""
            WITH r(host, path, action) AS (VALUES {rules}),
            u AS (SELECT page_id,
                translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
            b AS (SELECT page_id, max(struct_pack(long := length(r.host || r.path), host_long := length(r.host), block := (action = 'block')::INT, rule := r.host || r.path, action := action)) AS best
                FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY page_id)
            SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM u LEFT JOIN b USING (page_id)""",
        "op9_substrings": rf"""
            WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
            v AS (SELECT doc_id, k, hash(array_to_string(words[k:k + 19], ' ')) AS h FROM (
                SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS k FROM w WHERE len(words) >= 20)),
            again AS (SELECT doc_id, k FROM v QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, k) > 1),
            gone AS MATERIALIZED (SELECT doc_id, list(DISTINCT k + j) AS places FROM again, range(20) AS t(j) GROUP BY doc_id),
            one AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w),
            dropped AS MATERIALIZED (SELECT doc_id, unnest(places) AS k FROM gone),
            kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM one ANTI JOIN dropped USING (doc_id, k) GROUP BY doc_id)
            SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
            FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
        "op12_ranked_search": r"""
            WITH t AS MATERIALIZED (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
            q AS (
                SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
            d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
            c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
            m AS MATERIALIZED (SELECT doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) AS m FROM d, c),
            tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
            w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
            p AS MATERIALIZED (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS p FROM tf JOIN m USING (doc_id) JOIN w USING (term)),
            s AS (SELECT item_id, doc_id, sum(p)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL)
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
            FROM s WHERE score > 0 QUALIFY rank <= 50""",
        "op13_filter_audit": rf"""
            WITH said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
            x AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
                min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
            f AS MATERIALIZED (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, {{
                'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
                'C': 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(text),
                'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)}} AS v FROM x LEFT JOIN said USING (doc_id)),
            g AS MATERIALIZED (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN v.A WHEN 'B' THEN v.B WHEN 'C' THEN v.C WHEN 'D' THEN v.D ELSE v.E END) AS fails,
                count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad FROM f GROUP BY ALL),
            k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
            o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
            s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
            r AS (SELECT part, o, step, o[step] AS filter,
                coalesce(sum(n) FILTER (NOT list_has_any(fails, o[1:step])), 0) AS kept,
                coalesce(sum(n) FILTER (list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])), 0) AS removed,
                coalesce(sum(n) FILTER (list_contains(fails, o[step]) AND list_has_any(fails, o[1:step - 1])), 0) AS redundant,
                coalesce(sum(n) FILTER (fails = [o[step]]), 0) AS unique_fails,
                coalesce(sum(n_good) FILTER (list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])), 0) AS good_lost,
                coalesce(sum(n_bad) FILTER (list_contains(fails, o[step]) AND NOT list_has_any(fails, o[1:step - 1])), 0) AS toxic_lost
                FROM g, s GROUP BY ALL)
            SELECT part, array_to_string(o, '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
                good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r""",
    }
