"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, decontamination, line_dedup, mixing, near_dedup, quality, quality_rules, sharding, substring_dedup, token_counts, url_filter, whitening
from .common import table

SHARDS = 24


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null or empty text is scored by an empty text's statistics, a null id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), trainable=~quality.held_out(F.col("doc_id")))
    held = quality.held_out(F.col("doc_id")).alias("held_out")
    return quality.score(docs, model).select("doc_id", held, "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed and removed (spans with the first document's id) of every document; null and empty texts have no lines."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot and position of every document; a null source is the empty one, repeated rows have places of their own."""
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, removed, n_removed and removed_chars of every document; a null text stays null."""
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (rows), curve, shard, slot and grown_shard (null) of every document; a null text has size 8."""
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS, keep=["doc_id"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document; a null text has no words, benchmark rows without id or text no windows."""
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_leaves, and after one edit in the middle edited_tokens, edited_chars and reencoded_chars of every document; a null text has no tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Every document is edited in its middle: forty characters give way to a note.
    middle = F.expr("length(text) div 2")
    note = F.struct(middle.alias("start"), (middle + 40).alias("end"), F.lit(" [revised] ").alias("replacement"))
    counted = token_counts.count(docs).withColumn("counted", F.col("n_tokens"))
    edited = token_counts.apply_edits(counted.withColumn("edits", F.array(note)), keep=["doc_id", "counted"])
    sizes = [F.col("counted").alias("n_tokens"), F.size("leaf_tokens").alias("n_leaves"), F.col("n_tokens").alias("edited_tokens"), "edited_chars", "reencoded_chars"]
    return edited.select("doc_id", *sizes)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document; a null or empty text has no words and fails."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.drop("n_covered", "longest_repeat")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least id of its class), class_size and kept of every document; a null text is an empty one, texts without words are alike only if equal, a null id comes first."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("node")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits and score of every page; a null URL has empty parts and is allowed."""
    return url_filter.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; a null text is an empty one."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"], packed=True, decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


CENTROIDS, ROUNDS, DIMS = 40, 5, 64


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector; a null id is hashed as an empty one."""
    return clustering.cluster(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS, DIMS).drop("centroid")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable vector and component up to 16."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 16, keep=["vec_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_near_dedup": op9_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_bpe": op11_bpe,
    "op12_clustering": op12_clustering,
    "op13_whitening": op13_whitening,
}


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes: a fold over them with a table built from the polynomial."""
    return f"""xor(list_reduce([4294967295::UBIGINT] || list_transform(regexp_extract_all(hex(encode({text})), '..'),
        lambda h: ('0x' || h)::UBIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)"""


ORACLE: dict[str, str] = {}

ORACLE["op6_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM bs),
lens AS (SELECT DISTINCT n FROM grams),
ds AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM ds) JOIN grams USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN pos p USING (doc_id) LEFT JOIN its t USING (doc_id)
"""


def _hilbert_sql(dims: int, bits: int) -> str:
    """CTEs x0.. to ``curved(doc_id, curve, ...)`` over ``leveled(doc_id, ..., x0, x1, ...)``: one step of the transposition each."""
    xs = [f"x{i}" for i in range(dims)]
    rest = "doc_id, size, text_crc32"
    steps, last = [], "leveled"

    def add(new: dict[str, str]) -> None:
        nonlocal last
        name = f"h{len(steps)}"
        steps.append(f"{name} AS (SELECT {rest}, " + ", ".join(f"{new.get(x, x)} AS {x}" for x in xs) + f" FROM {last})")
        last = name

    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(dims):
            t = f"(xor(x0, x{i}) & {p})"
            new = {"x0": f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, {t}) END"}
            if i:
                new[f"x{i}"] = f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {t}) END"
            add(new)
    for i in range(1, dims):
        add({f"x{i}": f"xor(x{i}, x{i - 1})"})
    turn = "0"
    for b in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN x{dims - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    steps.append(f"turned AS (SELECT {rest}, {', '.join(xs)}, {turn} AS t FROM {last})")
    curve = " + ".join(f"(((xor(x{i}, t) >> {b}) & 1) << {b * dims + dims - 1 - i})" for b in range(bits) for i in range(dims))
    steps.append(f"curved AS (SELECT {rest}, {curve} AS curve FROM turned)")
    return ",\n".join(steps)


_CRC_TABLE = """crc_table AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n::UBIGINT] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t)"""


def _level_sql(col: str, bits: int) -> str:
    return f"(('0x' || substr(md5(coalesce({col}, '')), 1, 4))::INT >> {16 - bits})"


ORACLE["op5_sharding"] = f"""
WITH {_CRC_TABLE},
sized AS (SELECT doc_id, lang, source, CAST(coalesce(octet_length(encode(text)), 0) + 8 AS BIGINT) AS size,
    CAST({crc32_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents, crc_table),
leveled AS (SELECT doc_id, size, text_crc32, {_level_sql("lang", sharding.BITS)} AS x0, {_level_sql("source", sharding.BITS)} AS x1,
    least({(1 << sharding.BITS) - 1}, greatest(0, (length(bin(size)) - 4) * 2 + substr(bin(size), 2, 1)::INT))::INT AS x2 FROM sized),
{_hilbert_sql(3, sharding.BITS)},
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, size, text_crc32, doc_id) - 1 AS r, count(*) OVER () AS n FROM curved),
cut AS (SELECT *, (r * {SHARDS}) // n AS shard FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(curve AS INT) AS curve, CAST(shard AS INT) AS shard,
       CAST(r - (shard * n + {SHARDS - 1}) // n_shards AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM (SELECT *, {SHARDS} AS n_shards FROM cut)
"""

# One walk over all slots, by the exact weights: blocks are released and due as the operator defines, a source that has run out leaves its slots empty.
ORACLE["op3_mixing"] = f"""
WITH RECURSIVE named AS (SELECT coalesce(source, '') AS name, count(*) AS n, pow(count(*), {mixing.TEMPERATURE}) AS share FROM documents GROUP BY 1),
lanes AS (SELECT name, n, row_number() OVER (ORDER BY name) - 1 AS lane, greatest(1, round_even(share / (SELECT list_sum(list(share ORDER BY name)) FROM named) * {mixing.SCALE}, 0))::HUGEINT AS w FROM named),
lists AS (SELECT list(w ORDER BY lane) AS w, list(n ORDER BY lane) AS n, sum(w)::HUGEINT AS whole FROM lanes),
long AS (SELECT max((((n + {mixing.BLOCK - 1}) // {mixing.BLOCK}) * whole + w - 1) // w) AS slots FROM lanes, (SELECT whole FROM lists)),
walk(slot, done, lane) AS (
    SELECT -1::BIGINT, list_transform(w, lambda x: 0::HUGEINT), -1::BIGINT FROM lists
    UNION ALL
    SELECT slot + 1, list_transform(done, lambda d, i: CASE WHEN i - 1 = pick THEN d + 1 ELSE d END), pick
    FROM (SELECT slot, done, (list_min(list_filter(list_transform(done, lambda d, i: CASE WHEN (d * whole) // w[i] <= slot + 1
              THEN (((d + 1) * whole + w[i] - 1) // w[i]) * 100000 + i - 1 END), lambda x: x IS NOT NULL)) % 100000)::BIGINT AS pick
          FROM walk, lists, long WHERE slot + 1 < slots)),
turns AS (SELECT slot, walk.lane, done[walk.lane + 1] - 1 AS block, list_sum(list_transform(done, lambda d, i: least(n[i], (CASE WHEN i - 1 = walk.lane THEN d - 1 ELSE d END) * {mixing.BLOCK}))) AS first FROM walk, lists WHERE slot >= 0),
ranked AS (SELECT doc_id, d.source, x.lane, row_number() OVER (PARTITION BY x.lane ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))) - 1 AS r
    FROM documents d JOIN lanes x ON coalesce(d.source, '') = x.name)
SELECT doc_id, source, CAST(t.block AS BIGINT) AS block, CAST(t.slot AS BIGINT) AS slot, CAST(t.first + r % {mixing.BLOCK} AS BIGINT) AS position
FROM ranked b JOIN turns t ON t.lane = b.lane AND t.block = b.r // {mixing.BLOCK}
"""


def _terms_sql(terms: tuple[str, ...]) -> str:
    """How many distinct terms stand in ``u``, bounded by anything but ASCII letters and digits."""
    return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)', 's')::BIGINT" for t in terms)


def _rules_sql() -> str:
    rows = ", ".join(f"('{kind}', '{host}', '{path}')" for kind, host, path in url_filter.RULES)
    return f"rules AS (SELECT * FROM (VALUES {rows}) AS r(kind, rule_host, rule_path))"


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE["op10_url_filter"] = f"""
WITH {_rules_sql()},
after AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a, translate(coalesce(url, ''), {_AZ}) AS u FROM pages),
parts AS (SELECT page_id, u, translate(regexp_extract(a, '^([^/?#]*)', 1, 's'), {_AZ}) AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM after),
fits AS (SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(kind, length(rule_host || rule_path)) AS kind
    FROM (SELECT DISTINCT page_id, host, path FROM parts) p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL),
hits AS (SELECT *, {_terms_sql(url_filter.STRICT)} AS strict_hits, {_terms_sql(url_filter.SOFT)} AS soft_hits FROM parts)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.kind, CASE WHEN strict_hits >= 1 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(strict_hits AS BIGINT) AS strict_hits, CAST(soft_hits AS BIGINT) AS soft_hits, CAST(2 * strict_hits + soft_hits AS DOUBLE) AS score
FROM hits h LEFT JOIN fits f ON h.page_id = f.page_id AND h.host = f.host AND h.path = f.path
"""


ORACLE["op8_quality_rules"] = rf"""
WITH dw AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT *, len(w) AS n, CAST(floor(greatest({quality_rules.MAX_REPEAT}, len(w) * 0.1)) AS BIGINT) + 1 AS long FROM dw),
short AS (SELECT k, i, array_to_string(w[i + 1 : i + {quality_rules.WINDOW}], ' ') AS g FROM n, unnest(range(0, n - {quality_rules.WINDOW - 1})) AS u(i)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM short) WHERE c > 1),
wide AS (SELECT k, i, md5(array_to_string(w[i + 1 : i + {quality_rules.MIN_REPEAT}], ' ')) AS g FROM n, unnest(range(0, n - {quality_rules.MIN_REPEAT - 1})) AS u(i)),
wide_twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM wide) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT p) AS n_covered FROM (SELECT k, unnest(range(i, i + {quality_rules.MIN_REPEAT})) AS p FROM wide_twice) GROUP BY k),
rep AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + {quality_rules.WINDOW})) AS p FROM twice) GROUP BY k),
long_twice AS (SELECT DISTINCT k FROM (SELECT k, md5(array_to_string(w[i + 1 : i + long], ' ')) AS g FROM n, unnest(range(0, n - long + 1)) AS u(i)) GROUP BY k, g HAVING count(*) > 1),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM dw) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
counts AS (SELECT n.k, doc_id, n AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered, t.k IS NOT NULL AS too_long
    FROM n LEFT JOIN rep USING (k) LEFT JOIN cov USING (k) LEFT JOIN dup USING (k) LEFT JOIN long_twice t USING (k)),
judged AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_WINDOW_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND n_covered <= n_words * {quality_rules.MAX_COVERED} AND NOT too_long AS kept
FROM judged
"""


def _clustering_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """One CTE a round for the assignments and one for the centroids that follow; floors of the means are taken in integers."""
    steps = [f"""usable AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
    f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM usable QUALIFY c < {k})"]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, vec_id, v, c, d FROM (SELECT u.r, u.vec_id, u.v, c, list_sum(list_transform(list_zip(u.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM usable u CROSS JOIN c{i} m) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT c, j, sum(v[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, unnest(range(1, {dims + 1})) AS t(j) GROUP BY c, j),
    m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY c),
    c{i + 1} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))""")
    return f"""WITH {",\n".join(steps)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} m USING (c)"""


ORACLE["op12_clustering"] = _clustering_sql(CENTROIDS, ROUNDS, DIMS, 256, 2)
