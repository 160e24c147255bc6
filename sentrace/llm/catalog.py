"""Registered queries of the text operators and the SQL text that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrace.llm import (
    collocations,
    decontamination,
    language_id,
    licenses,
    line_dedup,
    neighbours,
    packing,
    quality,
    shingle_join,
    spelling,
    substring_dedup,
    url_filter,
    warc,
)
from sentrace.llm.session import prepare, read
from sentrace.storage import materialise

#: The contract's rules: (host, path, verdict).
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.known_licenses(spark)).select("doc_id", "license", "notices")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = language_id.held_out("doc_id", 3, 1)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels").where(~split))
    return quality.score_quality(docs.withColumn("held_out", split), model).select("doc_id", "held_out", "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id", 4, 2))
    models = language_id.fit_languages(docs.where("NOT held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), models).drop("text")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return out.withColumnRenamed("id", "doc_id").drop("digest", "ids")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = prepare(spark).createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shingle_join.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.round_trip(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = materialise(spelling.count_words(read(spark, sf_dir, "documents").select("doc_id", "text")), "vocabulary")
    return spelling.group_variants(counted).select("word", "form", "root", "n", "n_near", "form_n")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(replace(lower({text}), '©', 'c'), {_quoted(licenses.NOT_WORD)}, ' ', 'g')"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    lines = f"list_transform(string_split({out}, chr(10)), lambda l: trim(l))"
    return f"list_filter({lines}, lambda l: l <> '' AND NOT regexp_matches(l, {_quoted(licenses.COPYRIGHT_LINE)}))"


_OP2 = f"""
WITH given(license, text) AS (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in licenses.KNOWN)}),
known AS (
    SELECT array_to_string({_canonical_sql('text')}, ' ') AS body, min(license) AS license FROM given GROUP BY 1),
texts AS (SELECT doc_id, {_canonical_sql('text')} AS lines FROM documents),
notices AS (
    SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
    FROM (SELECT doc_id, unnest(lines) AS line FROM texts) JOIN known ON line = body GROUP BY doc_id)
SELECT t.doc_id, k.license, coalesce(n.notices, '') AS notices
FROM texts t LEFT JOIN known k ON len(t.lines) > 0 AND array_to_string(t.lines, ' ') = k.body
    LEFT JOIN notices n ON n.doc_id = t.doc_id
"""

_OP6 = f"""
WITH texts AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
tokens AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
windows AS (
    SELECT doc_id, pos, hash(array_to_string(words[pos : pos + {substring_dedup.WIDTH - 1}], ' ')) AS h,
        md5(array_to_string(words[pos : pos + {substring_dedup.WIDTH - 1}], ' ')) AS m
    FROM tokens WHERE pos + {substring_dedup.WIDTH - 1} <= len(words)),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY h, m) AS n FROM windows) WHERE n > 1),
marked AS (
    SELECT t.doc_id, t.pos, t.word, max(a.pos) OVER (PARTITION BY t.doc_id ORDER BY t.pos) AS last
    FROM tokens t LEFT JOIN again a ON a.doc_id = t.doc_id AND a.pos = t.pos),
kept AS (
    SELECT doc_id, count(*) FILTER (last > pos - {substring_dedup.WIDTH}) AS removed,
        string_agg(word, ' ' ORDER BY pos) FILTER (last IS NULL OR last <= pos - {substring_dedup.WIDTH}) AS body
    FROM marked GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(k.body, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

_OP7 = f"""
WITH rules(host, path, verdict) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
urls AS (
    SELECT page_id,
        CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
            '{url_filter.UPPER}', '{url_filter.LOWER}') ELSE '' END AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages),
fits AS (
    SELECT page_id, r.host || r.path AS rule, verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS nr
    FROM urls u JOIN rules r
        ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id AND f.nr = 1
"""

_OP10 = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr
    FROM documents WHERE text IS NOT NULL),
filled AS (
    SELECT doc_id, line, nr, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS BIGINT) AS pos
    FROM lines WHERE trim(line, ' ') <> ''),
runs AS (
    SELECT doc_id, pos, array_agg(line) OVER w AS run, count(*) OVER w AS n
    FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {line_dedup.MIN_LINES - 1} FOLLOWING)),
later AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nr FROM runs WHERE n = {line_dedup.MIN_LINES})
    WHERE nr > 1),
gone AS (
    SELECT DISTINCT f.doc_id, f.nr FROM filled f JOIN later l
        ON f.doc_id = l.doc_id AND f.pos BETWEEN l.pos AND l.pos + {line_dedup.MIN_LINES - 1}),
kept AS (
    SELECT l.doc_id, count(*) AS n, count(g.nr) AS removed,
        string_agg(l.line, chr(10) ORDER BY l.nr) FILTER (g.nr IS NULL) AS body
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.nr = g.nr GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.removed, 0) AS INTEGER) AS n_removed,
    sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

_OP11 = f"""
WITH rows AS (
    SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
planned AS (
    SELECT *, CASE WHEN size >= {warc.MIN_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY digest, size) END AS last FROM rows)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN last IS DISTINCT FROM page_id AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to
FROM planned
"""

_OP12 = f"""
WITH texts AS (
    SELECT row_number() OVER () AS rid, coalesce(lang, '{collocations.NO_LANG}') AS lang,
        regexp_split_to_array(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[.,;:!?\x0A-\x0D]') AS cut
    FROM documents),
pieces AS (SELECT rid, lang, unnest(cut) AS piece, generate_subscripts(cut, 1) AS piece_nr FROM texts),
split AS (SELECT rid, lang, piece_nr, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT rid, lang, piece_nr, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM split),
runs AS (
    SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3
    FROM words WINDOW p AS (PARTITION BY rid, piece_nr ORDER BY pos)),
f1 AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
    SELECT g.lang, g.w1 || ' ' || g.w2 AS phrase, g.f AS a, 1 AS k, x.f AS l, y.f AS r
    FROM f2 g JOIN f1 x ON g.lang = x.lang AND g.w1 = x.w1 JOIN f1 y ON g.lang = y.lang AND g.w2 = y.w1
    UNION ALL
    SELECT g.lang, concat_ws(' ', g.w1, g.w2, g.w3), g.f, 1, x.f, y.f
    FROM f3 g JOIN f1 x ON g.lang = x.lang AND g.w1 = x.w1 JOIN f2 y ON g.lang = y.lang AND g.w2 = y.w1 AND g.w3 = y.w2
    UNION ALL
    SELECT g.lang, concat_ws(' ', g.w1, g.w2, g.w3), g.f, 2, x.f, y.f
    FROM f3 g JOIN f2 x ON g.lang = x.lang AND g.w1 = x.w1 AND g.w2 = x.w2 JOIN f1 y ON g.lang = y.lang AND g.w3 = y.w1),
scored AS (
    SELECT *, (1000000 * CAST(a AS HUGEINT) * a) // (CAST(l AS HUGEINT) * r) AS score,
        row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000 * CAST(a AS HUGEINT) * a) // (CAST(l AS HUGEINT) * r), k) AS nr
    FROM cuts),
longer AS (
    SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3),
covered AS (SELECT lang, phrase, max(f) AS f FROM longer GROUP BY ALL),
kept AS (
    SELECT s.* FROM scored s LEFT JOIN covered c ON s.lang = c.lang AND s.phrase = c.phrase
    WHERE s.nr = 1 AND (c.f IS NULL OR 100 * c.f < 50 * s.a)),
total AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN total t ON r.lang = t.lang WHERE rank <= 2000
"""

# The checksum's table is built from its polynomial; near words share a deletion or one is a deletion of the other.
_OP13 = f"""
WITH RECURSIVE steps(i, c, nr) AS (
    SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) t(i)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, nr + 1 FROM steps WHERE nr < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE nr = 8),
runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
        unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[a-zÀ-ÿ]+')) AS run
    FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
    SELECT *, list_transform(range(strlen(id || ':' || run)), lambda k: CAST('0x' || substr(hex(encode(id || ':' || run)), CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT)) AS b
    FROM counted),
summed AS (
    SELECT run, n, xor(list_reduce(b, lambda s, x: xor(s >> 8, t[xor(s, x) % 256 + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
vocabulary AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (
    SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocabulary)),
near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
    UNION
    SELECT v.word, l.word, l.n FROM vocabulary v JOIN less l ON v.word = l.rest
    UNION
    SELECT l.word, v.word, v.n FROM vocabulary v JOIN less l ON v.word = l.rest),
best AS (
    SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS form, max(near_n) AS form_n FROM near GROUP BY word),
formed AS (
    SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * v.n THEN b.form END AS form,
        CASE WHEN b.form_n >= 2 * v.n THEN b.form_n END AS form_n
    FROM vocabulary v LEFT JOIN best b ON v.word = b.word),
chain(word, root, depth) AS (
    SELECT word, word, 0 FROM formed
    UNION ALL
    SELECT c.word, f.form, c.depth + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) r ON f.word = r.word
"""

QUERIES = {
    "op9_jaccard_join": op9_jaccard_join,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op5_packing": op5_packing,
    "op1_decontamination": op1_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_language_id": op4_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op7_url_filter": op7_url_filter,
    "op10_line_dedup": op10_line_dedup,
    "op11_warc": op11_warc,
    "op12_collocations": op12_collocations,
    "op13_spelling": op13_spelling,
}
ORACLE = {
    "op6_substring_dedup": _OP6,
    "op2_license_scan": _OP2,
    "op7_url_filter": _OP7,
    "op10_line_dedup": _OP10,
    "op11_warc": _OP11,
    "op12_collocations": _OP12,
    "op13_spelling": _OP13,
}
