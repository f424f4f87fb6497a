"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fingerprints, html_extract, langid, licenses, mixing, neardup, packing, quality_rules, rule_ensemble, sharding, variants, warc
from .common import table


def word_count(text: str = "text"):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text column; null: 0."""
    plain = F.trim(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " +"))).cast("long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mixing.mix_documents(docs, "size").select("doc_id", "size", "source_size", "target", (F.col("first_words") + F.col("second_words")).alias("taken"), "first_slot", "last_slot")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rule_ensemble.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok")


def language_model(docs: DataFrame) -> langid.LanguageField:
    """Learned only from rows whose crc32(doc_id as text) mod 3 isn't 1."""
    return langid.fit(docs.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return langid.predict(docs, language_model(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"))
    got = sharding.shard_by_bytes(rows, "size", ["digest", "doc_id"], group="digest")
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_fingerprints, op3_mixing, op4_html, op5_packing, op6_quality_score, op7_near_duplicates, op8_warc, op9_language, op10_sharding, op11_divergence, op12_spelling_variants, op13_licenses)}


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
m AS (SELECT *, max(level) OVER () AS flat FROM l),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, flat * w) AS target FROM m),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d),
g AS (SELECT p.doc_id, p.source, p.size, t.source_size, t.target, a, a + t.source_size AS a2,
  greatest(0, least(a + p.size, floor(t.target)) - a) AS n1, greatest(0, least(a + p.size + t.source_size, floor(t.target)) - (a + t.source_size)) AS n2
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
b AS (SELECT source, CAST(ceil(floor(target) / 1024) AS HUGEINT) AS blocks FROM t WHERE floor(target) > 0),
c AS (SELECT *, coalesce(sum(blocks) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before, (sum(blocks) OVER ())::HUGEINT AS total FROM b),
i AS (SELECT *, (before * points) // total AS lo, ((before + blocks) * points) // total AS hi FROM (SELECT *, CAST(power(2, bits) AS HUGEINT) AS points FROM (SELECT *, CAST(greatest(1, length(ltrim(bin(CAST(2 * total - 1 AS BIGINT)), '0'))) AS INT) AS bits FROM c))),
v AS (SELECT slot, CAST(list_sum(list_transform(range(bits), lambda j: ((slot >> j) & 1) << (bits - 1 - j))) AS HUGEINT) AS point FROM (SELECT max(bits) AS bits FROM i), range(CAST((SELECT max(points) FROM i) AS BIGINT)) r(slot)),
k AS (SELECT * FROM (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM v JOIN i ON point >= lo AND point < hi) WHERE rank < blocks)
SELECT g.doc_id, g.size, g.source_size, g.target, CAST(n1 + n2 AS BIGINT) AS taken, f.slot AS first_slot, e.slot AS last_slot FROM g
LEFT JOIN k f ON f.source IS NOT DISTINCT FROM g.source AND n1 > 0 AND f.rank = CAST(floor(a / 1024) AS BIGINT)
LEFT JOIN k e ON e.source IS NOT DISTINCT FROM g.source AND n1 > 0 AND e.rank = CAST(floor((CASE WHEN n2 > 0 THEN a2 + n2 ELSE a + n1 END - 1) / 1024) AS BIGINT)
"""

#: Equal texts stand together; a cut inside a group that fits in a shard moves to the group's nearer end.
OP10_SQL = r"""
WITH z AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(range(8), lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i) AS v FROM range(256) x(i))),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 1 AS size, md5(coalesce(text, '')) AS digest,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda v, y: xor(v >> 8, steps[xor(v & 255, y) + 1]), 4294967295), 4294967295) AS text_crc32 FROM documents, z),
r AS (SELECT *, coalesce(sum(size) OVER w, 0) AS a, row_number() OVER (ORDER BY digest, doc_id NULLS FIRST) - 1 AS place, sum(size) OVER () AS total FROM d
  WINDOW w AS (ORDER BY digest, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT digest, min(a) AS lo, max(a + size) AS hi FROM r GROUP BY digest),
t AS (SELECT k, (total * k + 15) // 16 AS target, total FROM (SELECT max(total) AS total FROM r), range(1, 16) x(k)),
c AS (SELECT k, coalesce(CASE WHEN (hi - lo) * 16 <= total THEN CASE WHEN target - lo <= hi - target THEN lo ELSE hi END END, target) AS cut FROM t LEFT JOIN g ON lo < target AND target < hi),
s AS (SELECT r.*, (SELECT count(*) FROM c WHERE cut <= r.a) AS shard FROM r)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""

OP8_SQL = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < head THEN head END AS refers_to, true AS payload_ok FROM g
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS in_lang FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
y AS (SELECT x.*, sum(x.n) OVER (PARTITION BY x.lang, x.source) AS own, v.terms, v.total FROM x JOIN v ON v.lang = x.lang),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (own + 5 * terms) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (in_lang + 5)) // (total + 5 * terms) AS BIGINT) AS q FROM y),
s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""

#: Near words: both come to one string by deleting a letter at one place, or one of them to the other.
OP12_SQL = r"""
WITH RECURSIVE z AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(range(8), lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i) AS v FROM range(256) x(i))),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents),
r AS (SELECT doc, run, count(*) AS n FROM o GROUP BY doc, run),
h AS (SELECT run, n, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda v, y: xor(v >> 8, steps[xor(v & 255, y) + 1]), 4294967295), 4294967295) AS h FROM r, z),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
e AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
l AS (SELECT DISTINCT word, less FROM e),
a AS (SELECT a.word, b.word AS other FROM e a JOIN e b ON a.i = b.i AND a.less = b.less AND a.word <> b.word UNION SELECT l.word, w.word FROM l JOIN w ON w.word = l.less UNION SELECT w.word, l.word FROM l JOIN w ON w.word = l.less),
f AS (SELECT a.word, count(*) AS n_near, max(b.n) AS top FROM a JOIN w b ON b.word = a.other GROUP BY a.word),
t AS (SELECT f.word, f.n_near, f.top, min(a.other) AS best FROM f JOIN a ON a.word = f.word JOIN w b ON b.word = a.other AND b.n = f.top GROUP BY ALL),
y AS (SELECT w.word, w.n, coalesce(t.n_near, 0) AS n_near, CASE WHEN t.top >= 10 * w.n THEN t.best END AS form, CASE WHEN t.top >= 10 * w.n THEN t.top END AS form_n FROM w LEFT JOIN t ON t.word = w.word),
u AS (SELECT word, form AS root, 1 AS depth FROM y WHERE form IS NOT NULL UNION ALL SELECT u.word, y.form, depth + 1 FROM u JOIN y ON y.word = u.root WHERE y.form IS NOT NULL),
x AS (SELECT word, max_by(root, depth) AS root FROM u GROUP BY word)
SELECT y.word, y.form, coalesce(x.root, y.word) AS root, y.n, CAST(y.n_near AS BIGINT) AS n_near, y.form_n FROM y LEFT JOIN x ON x.word = y.word
"""


def _op13_sql() -> str:
    """Templates and phrases as rows; every block of every text against every template."""
    rows, said = [], []
    for i, (label, text) in enumerate(licenses.TEMPLATES):
        own = set(text.split())
        rows += [f"({i}, '{label}', {licenses.step(len(text.split()))}, {len(own)}, {licenses.needed(len(own), 0.9)}, '{w}')" for w in sorted(own)]
    inside = [(i, j) for i, (_, a) in enumerate(licenses.TEMPLATES) for j, (_, b) in enumerate(licenses.TEMPLATES) if set(a.split()) < set(b.split())]
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        said.append(f"SELECT row, p, '{label}' AS label FROM o WHERE " + " AND ".join(f"words[p + {j + 1}] = '{w}'" for j, w in enumerate(parts)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
o AS (SELECT row, words, unnest(range(len(words))) AS p FROM d),
b AS ({" UNION ALL ".join(said)}),
s AS (SELECT row, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY row),
t(template, label, step, size, need, word) AS (VALUES {", ".join(rows)}),
q AS (SELECT o.row, t.template, t.label, t.step, t.size, t.need, o.p // t.step AS k, t.word FROM o JOIN t ON t.word = o.words[o.p + 1]),
e AS (SELECT * FROM q UNION ALL SELECT * REPLACE (k - 1 AS k) FROM q WHERE k > 0),
m AS (SELECT row, template, label, step, k, count(DISTINCT word) / size AS containment FROM e GROUP BY row, template, label, step, k, size, need HAVING count(DISTINCT word) >= need),
i(part, whole) AS (VALUES {", ".join(map(str, inside))}),
f AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM i JOIN m n ON n.template = i.whole WHERE i.part = m.template AND n.row = m.row AND n.step = m.step AND n.k = m.k)),
l AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM f UNION ALL SELECT row, label FROM b) GROUP BY row),
c AS (SELECT row, max(containment) AS best FROM f GROUP BY row)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(s.n_base, 0) AS BIGINT) AS n_base, s.first_word, s.last_word, coalesce(s.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN s.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c.best, 0.0::DOUBLE) END AS score FROM d LEFT JOIN s ON s.row = d.row LEFT JOIN l ON l.row = d.row LEFT JOIN c ON c.row = d.row
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op8_warc": OP8_SQL, "op10_sharding": OP10_SQL, "op11_divergence": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_licenses": _op13_sql()}
