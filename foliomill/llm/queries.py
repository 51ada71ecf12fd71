"""One query for each operator of this subpackage, and SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, ctw, fingerprints, jaccard, licenses, neighbours, packing, quality, resampling, secrets, spelling, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


#: the text of conversation -1
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "conv_id long, turn long, role string, text string"
    control = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], columns)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    parts = turns.select("conv_id", "turn", "role", F.array(chat.part(text=F.coalesce("text", F.lit("")))).alias("parts"))
    return chat.read_back(chat.conversations(parts)).drop("expanded_tokens", "n_attachments")


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with an attachment in each turn: an image, sound or document that follows from the turn's number and length."""
    turns = table(spark, sf_dir, "conversations")
    text, turn = F.coalesce("text", F.lit("")), F.coalesce("turn", F.lit(0)).cast("int")
    n = F.length(text)
    attached = (
        F.when(turn % 3 == 0, chat.part(kind=F.lit("image"), ref=F.lit("i"), width=n + 1, height=F.lit(400)))
        .when(turn % 3 == 1, chat.part(kind=F.lit("audio"), ref=F.lit("a"), seconds=n / 4))
        .otherwise(chat.part(kind=F.lit("document"), ref=F.lit("d"), pages=n % 5 + 1))
    )
    parts = turns.select("conv_id", "turn", "role", F.array(chat.part(text=text), attached, chat.part(text=F.lit(" [end]"))).alias("parts"))
    return chat.read_back(chat.conversations(parts))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, ledger = secrets.update_ledger(table(spark, sf_dir, "documents"))
    found = secrets.findings_by_path(held, ledger)
    columns = secrets.span_columns(F.col("findings"))
    return found.select(F.col("path").alias("doc_id"), *[c.alias(k) for k, c in columns.items()])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _dated_lists(pages: DataFrame) -> DataFrame:
    """Dated list histories over the hosts of ``pages``: rules on a digest of the domain."""
    domain = pages.select(F.explode(urls.suffixes(urls.host(F.col("url")))).alias("domain")).distinct().filter("domain <> ''")
    digit = lambda at, n: F.conv(F.substring(F.md5(F.col("domain").cast("binary")), at, n), 16, 10).cast("int")
    seed = domain.select("domain", digit(1, 2).alias("a"), digit(3, 2).alias("b"), digit(5, 2).alias("c"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    first, last, back = F.col("a"), F.col("a") + F.col("b") % 60 + 1, F.col("a") + F.col("b") % 60 + 31
    event = lambda name, action, at: F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), day(at).alias("day"))
    spam = F.when(F.col("c") % 3 == 0, F.array(event("spam", "add", first), event("spam", "remove", last), event("spam", "add", back)))
    adult = F.when(F.col("c") % 5 == 0, F.array(event("adult", "add", first)))
    none = F.array().cast("array<struct<list:string,action:string,day:date>>")
    return seed.select("domain", F.explode(F.concat(F.coalesce(spam, none), F.coalesce(adult, none))).alias("e")).select("e.list", "domain", "e.action", "e.day")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")))
    judged = urls.evaluate(captures, _dated_lists(pages))
    lists = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["list"]))), ",")
    return judged.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), F.size("matches").cast("long").alias("n_matches"), lists.alias("lists"), (F.size("matches") > 0).alias("blocked"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["from"].cast("string"), s["to"].cast("string")))
    return scanned.withColumn("spans", F.array_join(spans, ","))


def op10_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_best_fit_packing, op2_chat_format, chat_typed_parts, op3_secret_scan, op4_quality_rules, op5_ngram_jaccard_join, op6_ctw_score, op7_byte_bpe, op8_url_filter, op9_license_scan, op10_merkle_fingerprint, op11_nearest_neighbours, op12_spelling_variants, op13_importance_resampling)}

_CHAT_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
), e AS (
  SELECT *, 23 + length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_PARTS_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body, coalesce(text, '') || ' [end]' AS text, CAST(coalesce(turn, 0) AS INT) % 3 AS kind FROM conversations
), e AS (
  SELECT *, CASE kind WHEN 0 THEN CAST(ceil((length(body) + 1) / 336) AS BIGINT) * 2 * 576 WHEN 1 THEN CAST(ceil(length(body) / 4 * 25) AS BIGINT) ELSE (length(body) % 5 + 1) * 800 END AS tokens,
    23 + length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) AS chars FROM t
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS at FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE kind WHEN 0 THEN 11 WHEN 1 THEN 11 ELSE 14 END) AS BIGINT) AS formatted_chars,
  CAST(sum(tokens) AS BIGINT) AS expanded_tokens, count(*) AS n_attachments
FROM n GROUP BY conv_id
"""

_URL_SQL = rf"""
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 365 AS INT) AS fetched,
    lower(regexp_extract(url, '{urls.HOST}', 1)) AS host
  FROM pages
), hosts AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM p WHERE host <> ''),
suffix AS (
  SELECT DISTINCT host, array_to_string(l[i:len(l)], '.') AS domain
  FROM (SELECT host, l, unnest(generate_series(1, greatest(len(l) - 1, 1))) AS i FROM hosts WHERE NOT regexp_matches(host, '{urls.ADDRESS}'))
  UNION SELECT host, host FROM hosts WHERE regexp_matches(host, '{urls.ADDRESS}')
), seed AS (
  SELECT domain, CAST('0x' || substr(md5(domain), 1, 2) AS INT) AS a, CAST('0x' || substr(md5(domain), 3, 2) AS INT) AS b, CAST('0x' || substr(md5(domain), 5, 2) AS INT) AS c
  FROM (SELECT DISTINCT domain FROM suffix)
), span AS (
  SELECT 'spam' AS list, domain, DATE '2024-01-01' + a AS f, DATE '2024-01-01' + (a + b % 60 + 1) AS t FROM seed WHERE c % 3 = 0
  UNION ALL SELECT 'spam', domain, DATE '2024-01-01' + (a + b % 60 + 31), NULL FROM seed WHERE c % 3 = 0
  UNION ALL SELECT 'adult', domain, DATE '2024-01-01' + a, NULL FROM seed WHERE c % 5 = 0
)
SELECT page_id, any_value(p.host) AS host, CAST(any_value(fetched) AS VARCHAR) AS fetched, count(span.list) AS n_matches,
  coalesce(string_agg(DISTINCT span.list, ',' ORDER BY span.list), '') AS lists, count(span.list) > 0 AS blocked
FROM p LEFT JOIN suffix s ON s.host = p.host LEFT JOIN span ON span.domain = s.domain AND span.f <= fetched AND (span.t IS NULL OR fetched < span.t)
GROUP BY page_id
"""

def _leaves_sql(text: str) -> str:
    parts = f"regexp_extract_all({text}, '{fingerprints.PARAGRAPHS[0]}')"
    for pattern in fingerprints.PARAGRAPHS[1:]:
        parts = f"flatten(list_transform({parts}, lambda p: regexp_extract_all(p, '{pattern}')))"
    return f"list_transform({parts}, lambda x: substr(md5(x), 1, {fingerprints.LEAF_DIGITS}))"


def _print_sql(leaf: str) -> str:
    body = f"regexp_replace(array_to_string(list_transform({leaf}, lambda h: h || CASE WHEN right(h, 1) = '0' THEN ';' ELSE ',' END), ''), '[,;]$', '')"
    return f"md5(array_to_string(list_transform(string_split({body}, ';'), lambda s: md5(s)), '')) || ':' || {body}"


def _like_sql(a: str, b: str) -> str:
    """Likeness of fingerprint columns, by sections and then leaves."""
    cut = lambda p: f"list_filter(string_split(split_part({p}, ':', 2), ';'), lambda s: s <> '')"
    lack = lambda x, y: f"flatten(list_transform(list_filter(list_distinct({cut(x)}), lambda s: NOT list_contains({cut(y)}, s)), lambda s: string_split(s, ',')))"
    same = f"len(flatten(list_transform(list_intersect(list_distinct({cut(a)}), list_distinct({cut(b)})), lambda s: string_split(s, ','))))"
    common, either = f"len(list_intersect(list_distinct({lack(a, b)}), list_distinct({lack(b, a)})))", f"len(list_distinct(list_concat({lack(a, b)}, {lack(b, a)})))"
    return f"CASE WHEN split_part({a}, ':', 1) = split_part({b}, ':', 1) THEN 1.0 ELSE ({same} + {common}) / ({same} + {either}) END"


def _differing_sql(a: str, b: str) -> str:
    cut = lambda p: f"list_filter(string_split(split_part({p}, ':', 2), ';'), lambda s: s <> '')"
    return f"array_to_string(list_transform(list_filter(generate_series(1, len({cut(a)})), lambda i: NOT list_contains({cut(b)}, {cut(a)}[i])), lambda i: CAST(i - 1 AS VARCHAR)), ',')"


_FINGERPRINT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC, text), first_value(text) OVER (ORDER BY doc_id DESC, text)) AS next FROM d),
e AS (SELECT doc_id, text, next, length(text) AS c, left(text, CAST(length(text) - length(text) // 3 AS INT)) || left(next, CAST(length(text) // 3 AS INT)) AS edited FROM n),
l AS (SELECT doc_id, c, edited, {_leaves_sql('text')} AS a, {_leaves_sql('edited')} AS b, {_leaves_sql('next')} AS x FROM e),
p AS (SELECT doc_id, c, edited, {_print_sql('a')} AS pa, {_print_sql('b')} AS pb, {_print_sql('x')} AS px FROM l)
SELECT doc_id, CAST(c AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, pa AS fingerprint, pb AS edited_fingerprint,
  CAST({_like_sql('pa', 'pb')} AS DOUBLE) AS near_edited, CAST({_like_sql('pa', 'px')} AS DOUBLE) AS near_next, {_differing_sql('pa', 'pb')} AS differing_sections FROM p
"""

#: the crc32 of an ASCII or UTF-8 string, by a table of 256 remainders
_CRC_TABLE = """crc AS (
  SELECT list(list_reduce(generate_series(1, 8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS remainders FROM generate_series(0, 255) g(i)
)"""


def _crc_sql(text: str) -> str:
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    return f"xor(4294967295, list_reduce(list_transform(generate_series(1, strlen({text})), lambda i: {digit('2 * i - 1')} * 16 + {digit('2 * i')}), lambda c, b: xor(remainders[xor(c, b) % 256 + 1], c // 256), 4294967295))"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPELLING_SQL = rf"""
WITH {_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY doc_id, run
), hashed AS (SELECT run, k, {_crc_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM runs, crc
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT word, n, length(word) AS chars, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM (SELECT word, n, CAST(0 AS INT) FROM words)) s(word, n, i)
), near AS (
  SELECT a.word AS word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, max(other_n) AS most, first(other ORDER BY other_n DESC, other) AS leader FROM near GROUP BY word),
led AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN leader END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM words w LEFT JOIN best ON best.word = w.word),
walk AS (SELECT word, word AS reached, 0 AS step FROM led UNION ALL SELECT walk.word, led.form, step + 1 FROM walk JOIN led ON led.word = walk.reached WHERE led.form IS NOT NULL)
SELECT led.word, led.form, r.root, led.n, led.n_near, led.form_n FROM led JOIN (SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word) r ON r.word = led.word
""".replace("WITH crc", "WITH RECURSIVE crc")

_RESAMPLING_SQL = rf"""
WITH {_CRC_TABLE}, d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), f AS (SELECT r, unnest(w) AS feature FROM d),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS feature FROM benchmark),
both_texts AS (SELECT feature, count(*) AS s, 0 AS t FROM f GROUP BY feature UNION ALL SELECT feature, 0, count(*) FROM b GROUP BY feature),
distinct_features AS (SELECT feature, sum(s) AS s, sum(t) AS t FROM both_texts GROUP BY feature),
hashed AS (SELECT feature, s, t, {_crc_sql('feature')} % 10000 AS bucket FROM distinct_features, crc),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM hashed),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(sum(t) AS DOUBLE) + 1) * (CAST(any_value(all_s) AS DOUBLE) + 10000) / ((CAST(sum(s) AS DOUBLE) + 1) * (CAST(any_value(all_t) AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM hashed, totals GROUP BY bucket),
summed AS (SELECT r, CAST(sum(gain) AS BIGINT) AS total, count(*) AS k FROM f JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_features, coalesce((total - ((total % k) + k) % k) // k, 0) AS weight, CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM d LEFT JOIN summed USING (r)
), s AS (SELECT doc_id, r, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM s)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank, n_features AS n_words FROM placed
"""

ORACLES: dict[str, str] = {"op12_spelling_variants": _SPELLING_SQL, "op13_importance_resampling": _RESAMPLING_SQL, "op2_chat_format": _CHAT_SQL, "chat_typed_parts": _PARTS_SQL, "op8_url_filter": _URL_SQL, "op10_merkle_fingerprint": _FINGERPRINT_SQL}
