"""The queries of this package over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from . import bpe, cotraining, decontaminate, filter_audit, manifest, packing, quality_rules, repeats, secrets, sharding, simhash, url_lists, warc
from .common import shared_path, table

RANKS = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return register


def token_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.round_trip(docs, public_tokenizers.path(RANKS))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_bpe_tree")
def bpe_tree(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_spaced_seed_decontamination")
def spaced_seed_decontamination(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_tiled_simhash")
def tiled_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


@query("op6_risk_controlled_rules")
def risk_controlled_rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def _is_kind(kind):
    return lambda span: span["kind"] == kind


@query("op8_linked_secrets")
def linked_secrets(spark, sf_dir):
    found = secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.STRONG))
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in secrets.STRONG]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query("op7_bfd_packing")
def bfd_packing(spark, sf_dir):
    """The matrices of the whole table are written, and the rows are read back from their files."""
    rows = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
    return packing.read_matrices(packing.write_matrices(rows, shared_path(spark, "matrices")))


LIST_SQL = """
WITH visits AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) AS fetched,
  regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\\.+$', '') AS host, md5(coalesce(url, '')) AS h FROM pages),
entries AS (SELECT DISTINCT CASE WHEN substr(h, 4, 1) < '4' AND host LIKE '%.%.%' THEN regexp_replace(host, '^[^.]*\\.', '') ELSE host END AS domain,
  CAST(DATE '2024-01-01' + (ascii(substr(h, 2, 1)) * 16 + ascii(substr(h, 3, 1))) % 365 AS DATE) AS day,
  CASE WHEN substr(h, 1, 1) < '6' THEN 2 WHEN substr(h, 1, 1) < 'b' THEN 1 ELSE 0 END AS strict FROM visits WHERE host <> ''),
daily AS (SELECT domain, day, max(strict) AS strict FROM entries WHERE length(domain) <= 253 GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY domain ORDER BY day) AS until FROM daily),
parents AS (SELECT DISTINCT host, array_to_string(string_split(host, '.')[i:], '.') AS domain, i FROM visits, unnest(generate_series(1, len(string_split(host, '.')))) g(i) WHERE host <> ''
  AND length(array_to_string(string_split(host, '.')[i:], '.')) <= 253),
found AS (SELECT v.page_id, s.*, row_number() OVER (PARTITION BY v.page_id ORDER BY p.i) AS nth FROM visits v JOIN parents p USING (host) JOIN spans s ON s.domain = p.domain
  AND s.day <= v.fetched AND (s.until IS NULL OR v.fetched < s.until) WHERE s.strict > 0)
SELECT v.page_id, v.host, CAST(v.fetched AS VARCHAR) AS fetched, f.domain AS listed_domain, CASE f.strict WHEN 2 THEN 'block' WHEN 1 THEN 'allow' END AS action,
  CAST(f.day AS VARCHAR) AS valid_from, CAST(f.until AS VARCHAR) AS valid_to, coalesce(f.strict = 2, false) AS blocked
FROM visits v LEFT JOIN (SELECT * FROM found WHERE nth = 1) f USING (page_id)"""


@query("op9_temporal_url_lists", LIST_SQL)
def temporal_url_lists(spark, sf_dir):
    """Each page is a capture, and its URL's digest also gives a dated list entry for its host or that host's parent domain."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    start = F.lit("2024-01-01").cast("date")
    captures = pages.withColumn("fetched", F.date_add(start, (F.col("page_id") % 365).cast("int")))
    h, host = F.md5(F.coalesce("url", F.lit("")).cast("binary")), url_lists.host_of(F.col("url"))
    digit = lambda i: F.substring(h, i, 1)
    parent = F.when((digit(4) < "4") & host.like("%.%.%"), F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)
    entries = pages.select(parent.alias("domain"), F.date_add(start, (F.ascii(digit(2)) * 16 + F.ascii(digit(3))) % 365).alias("day"),
                           F.when(digit(1) < "6", "block").when(digit(1) < "b", "allow").otherwise("remove").alias("action"))
    out = url_lists.judge(captures, entries)
    return out.select("page_id", "host", "listed_domain", "action", *[F.col(c).cast("string").alias(c) for c in ("fetched", "valid_from", "valid_to")], "blocked")


@query("op10_splittable_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha1(body) AS digest, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY sha1(body)) END AS last FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM d""")
def splittable_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_cotraining_quality")
def cotraining_quality(spark, sf_dir):
    return cotraining.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 200)) AS h, substr(x, 2 * i + 1, 200) AS s FROM d, unnest(range(0, n - 99)) g(i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h, s ORDER BY doc_id, i) AS nth FROM w),
e AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE nth > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM e),
spans AS (SELECT doc_id, grp, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY ALL),
k AS (SELECT s.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
  string_agg(substr(x, 2 * coalesce(prev, 0) + 1, 2 * (a - coalesce(prev, 0))), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM spans) s JOIN d USING (doc_id) GROUP BY s.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


@query("op4_radix_suffix_dedup", REPEATS_SQL)
def radix_suffix_dedup(spark, sf_dir):
    found = repeats.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["finish"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


AUDIT_SQL = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN min(doc_id) OVER (PARTITION BY x) < doc_id THEN 16 ELSE 0 END AS mask FROM t),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY ALL),
l AS (SELECT chr(CAST(65 + i AS INTEGER)) AS c, 1 << i AS b FROM range(5) g(i)),
orders AS (SELECT v.c || w.c || x.c || y.c || z.c AS o FROM l v, l w, l x, l y, l z WHERE (v.b | w.b | x.b | y.b | z.b) = 31),
steps AS (SELECT o, step, substr(o, step, 1) AS letter, 1 << (ascii(substr(o, step, 1)) - 65) AS bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))), 0)::INTEGER AS prior FROM orders, range(1, 6) g(step)),
r AS (SELECT part, o, step, letter, coalesce(sum(n) FILTER (mask & (prior | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS toxic_lost
  FROM h, steps GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, letter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""


@query("op11_filter_audit", AUDIT_SQL)
def filter_interactions(spark, sf_dir):
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_minimax_shards")
def minimax_shards(spark, sf_dir):
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


MANIFEST_SQL = """
WITH RECURSIVE codes AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS codes FROM range(256) g(i)),
d AS (SELECT *, row_number() OVER () AS r, xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
  lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, codes),
pairs AS (SELECT r, doc_id, source, lang, n_chars, 0 AS changed, text FROM d UNION ALL SELECT r, doc_id, source, lang, n_chars, 1, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END FROM d),
h AS (SELECT r, doc_id, source, changed, sha256(array_to_string(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text],
  lambda v: CASE WHEN v IS NULL THEN '-' ELSE octet_length(encode(v)) || ':' || v END), '')) AS leaf FROM pairs),
leaves AS (SELECT a.r, a.doc_id, coalesce('s' || a.source, '') AS g, a.leaf, b.leaf AS now_, row_number() OVER (PARTITION BY a.source ORDER BY a.doc_id NULLS FIRST, a.leaf) - 1 AS idx, count(*) OVER (PARTITION BY a.source) AS n
  FROM h a JOIN h b USING (r) WHERE a.changed = 0 AND b.changed = 1),
low AS (SELECT 0 AS lvl, g, idx, n, leaf AS h FROM leaves UNION ALL SELECT lvl + 1, g, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY lvl, g, idx // 3, n),
subs AS (SELECT g, lvl AS height, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, idx, n, h FROM subs UNION ALL SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 3, n),
own AS (SELECT v.r, l.lvl, l.g, 0 AS top, l.idx, l.lvl AS nth FROM leaves v JOIN low l ON l.g = v.g AND l.idx = v.idx // CAST(3 ** l.lvl AS BIGINT) AND l.n > 1
  UNION ALL SELECT v.r, u.lvl, v.g, 1, u.idx, s.height + u.lvl FROM leaves v JOIN subs s USING (g) JOIN high u ON u.idx = s.idx // CAST(3 ** u.lvl AS BIGINT) AND u.n > 1),
every AS (SELECT 0 AS top, g, lvl, idx, h FROM low UNION ALL SELECT 1, '', lvl, idx, h FROM high),
steps AS (SELECT o.r, o.nth, coalesce(string_agg(e.h, '' ORDER BY e.idx) FILTER (e.idx < o.idx), '') AS ahead, coalesce(string_agg(e.h, '' ORDER BY e.idx) FILTER (e.idx > o.idx), '') AS behind
  FROM own o LEFT JOIN every e ON e.top = o.top AND e.lvl = o.lvl AND e.g = CASE WHEN o.top = 0 THEN o.g ELSE '' END AND e.idx // 3 = o.idx // 3 AND e.idx <> o.idx GROUP BY o.r, o.nth),
fold AS (SELECT r, 0 AS nth, now_ AS h FROM leaves UNION ALL SELECT f.r, f.nth + 1, sha256(s.ahead || f.h || s.behind) FROM fold f JOIN steps s ON s.r = f.r AND s.nth = f.nth),
ends AS (SELECT r, arg_max(h, nth) AS h FROM fold GROUP BY r),
proofs AS (SELECT r, string_agg(ahead || behind, '' ORDER BY nth) AS p FROM steps GROUP BY r)
SELECT v.doc_id, v.leaf, s.h AS subroot, t.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM leaves v JOIN subs s USING (g) JOIN ends e USING (r) LEFT JOIN proofs p USING (r), (SELECT h FROM high WHERE n = 1) t"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*manifest.FIELDS)
    fields = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in manifest.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, manifest.leaf_of(*fields))
    found = manifest.manifest(docs, tampered=tampered)
    hexed = found.select("doc_id", *[manifest.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], manifest.as_text(manifest.proof_of(F.col("path"))).alias("proof_sha256"),
                         manifest.as_text(manifest.folded(F.coalesce("tampered", "leaf"), F.col("path"))).alias("folded_root"))
    return hexed.withColumn("verified", F.col("folded_root") == F.col("root"))
