"""The registered queries of this subpackage, each on its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle
from . import chat, collocations, decontaminate, lengths, mixing, neardup, packing, pii, quality, sharding, structure, topk, urlrules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer file of the packing contract, where it is installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Words as the contracts define them, and a 32-bit portable hash, in DuckDB's SQL.
SQL_WORDS = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"
SQL_HASH = "('0x' || substr(md5(concat_ws('|', {0})), 1, 8))::BIGINT"

SHARDS, SHARD_SEED = 16, 20


@query("op1_feistel_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most."""
    docs = table(spark, sf_dir, "documents")
    whole = F.coalesce("text", F.lit(""))
    return sharding.shard(docs, SHARDS, SHARD_SEED).select(
        "doc_id", (F.octet_length(whole) + 1).cast("bigint").alias("size"), F.crc32(whole).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_dual_tree_top_k")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors by integer inner product of every fiftieth vector, against all."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op3_shortest_pack_first")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in sequences of 4096."""
    pieces = packing.tokenise(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query("op4_probminhash_classes")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of near copies it belongs to."""
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


OP5_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
views AS (
  SELECT t.*, participant, CASE WHEN speaker = participant THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN speaker <> participant AND speaker <> 'system' THEN speaker END AS name
  FROM t JOIN (SELECT DISTINCT conv_id AS c, speaker AS participant FROM t WHERE speaker <> 'system') p
    ON t.conv_id IS NOT DISTINCT FROM p.c),
s AS (
  SELECT *, '{chat.OPEN}' || role || coalesce(' name=' || name, '') || chr(10) || text || '{chat.CLOSE.strip()}' || chr(10) AS segment FROM views),
o AS (
  SELECT *, coalesce(sum(length(segment)) OVER (
    PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
  FROM s)
SELECT conv_id, participant, turn, role, name, segment, char_start,
  (char_start + length(segment) - length(text) - {len(chat.CLOSE)})::BIGINT AS mask_start,
  CASE WHEN speaker = participant THEN length(text) + {len(chat.CLOSE)} ELSE 0 END::BIGINT AS mask_length
FROM o
"""


@query("op5_perspectives", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from the perspective of each participant."""
    return chat.perspectives(table(spark, sf_dir, "conversations"))


@query("op6_bootstrapped_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(kind).__eq__)).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS[:4]]
    return found.select(
        "doc_id", *counts, F.sha2(pii.span_list(F.col("base_spans")), 256).alias("base_sha256"),
        pii.span_list(F.col("spans")).alias("spans"),
    )


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {SQL_WORDS.format('text')} AS w FROM documents),
triples AS (
  SELECT rid, i, h FROM (
    SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM (SELECT row_number() OVER () AS rid, * FROM d)
  ), LATERAL (SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS h)
),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, h) AS n FROM triples) WHERE n > 1),
reach AS (
  SELECT rid, sum(least(3, coalesce(lead_i - i, 3))) AS n FROM (
    SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS lead_i FROM twice) GROUP BY rid
),
r AS (SELECT row_number() OVER () AS rid, * FROM d),
lines AS (
  SELECT rid, coalesce(source, chr(0)) AS host, line, k FROM (
    SELECT rid, source, unnest(string_split(t, chr(10))) AS line FROM r
  ), LATERAL (SELECT regexp_replace(translate(lower(trim(line, ' ')), '123456789', '000000000'), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS k)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
)
SELECT r.doc_id, len(w)::BIGINT AS n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(reach.n, 0)::BIGINT AS n_repeat_words,
  (len(w) < 50 OR 100 * coalesce(reach.n, 0) > 50 * len(w)) AS base_failed
FROM r LEFT JOIN reach USING (rid)
LEFT JOIN (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid) dup USING (rid)
"""


@query("op7_line_frequency")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts on all documents; lines are counted per source."""
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op8_length_histogram")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every context limit would mean for all documents."""
    return lengths.suffix_sums(lengths.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_path()))


# The rules of the contract: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]

OP9_SQL = """
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES {rules}) AS t(rhost, rpath, rverdict)),
fits AS (
  SELECT DISTINCT host, path, rhost || rpath AS rule, rverdict FROM u JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (
  SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) = 1)
SELECT page_id, u.host, u.path, rule, coalesce(rverdict, 'allow') AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
""".format(rules=", ".join(str(r) for r in URL_RULES))


@query("op9_url_rules", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def source_weights(docs: DataFrame) -> DataFrame:
    """The contract's weights 5, 2, 1, repeating, over sources by code point, null last."""
    sources = docs.select("source").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.row_number().over(order) - 1) % 3 + 1)
    return sources.select("source", weight.alias("weight"))


@query("op10_splitting_tree_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all words takes of every document."""
    docs = table(spark, sf_dir, "documents")
    # The mix passes over its rows several times; the words are counted once.
    sized = settle(docs.select("doc_id", "source", F.size(quality.words(F.col("text"))).cast("bigint").alias("size")))
    mixed = mixing.mix(sized, source_weights(sized))
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda total, d: total + d["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '{word}') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
runs AS (
  SELECT rid, i, n, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT rid, i, runs.n AS n, item_id FROM runs JOIN windows USING (phrase)),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM found) GROUP BY rid),
items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list
  FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
""".format(upper="ABCDEFGHIJKLMNOPQRSTUVWXYZ", lower="abcdefghijklmnopqrstuvwxyz", word=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@query("op11_fm_index_decontamination", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document lies in windows of ten words that benchmark items hold."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
marked AS (
  SELECT raw.*, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS h FROM raw, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM marked, range(2) copies(c) WHERE h <> 0 AND (c = 0 OR h = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM damaged),
coded AS (
  SELECT *, role[1] AS r, CASE WHEN ending = '' THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
back AS (
  SELECT conv_id, max(n) AS pos, 0 AS e, 10 AS s, 5 AS u, 0 AS a FROM coded GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, least(pe, 5 + least(pu, 5 + pa)), least(ps, 5 + least(pu, 5 + pa)), least(pu, 5 + pa), least(pa, 5 + pu)
  FROM (
    SELECT x.conv_id, x.pos,
      least(2 + e, stay + least(1 + u, CASE r WHEN 's' THEN s WHEN 'u' THEN u ELSE 1000000 END)) AS pe,
      least(2 + s, stay + least(1 + u, CASE r WHEN 'u' THEN u ELSE 1000000 END)) AS ps,
      least(2 + u, stay + least(1 + a, CASE r WHEN 'a' THEN a ELSE 1000000 END)) AS pu,
      least(2 + a, stay + least(1 + u, CASE r WHEN 'u' THEN u ELSE 1000000 END)) AS pa
    FROM back JOIN (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000 END AS stay FROM coded) x
      ON x.conv_id IS NOT DISTINCT FROM back.conv_id AND x.pos = back.pos - 1)),
cost AS (SELECT conv_id, pos, unnest(['e', 's', 'u', 'a']) AS st, unnest([e, s, u, a]) AS c FROM back),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, 'e' AS st, '' AS audit, []::VARCHAR[] AS lines FROM coded GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos + (letter <> 'I')::INT, CASE letter WHEN 'D' THEN st WHEN 'K' THEN r ELSE nxt END, audit || letter,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN lines || [role || ':' || text]
      ELSE lines || [CASE nxt WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END] END
  FROM (
    SELECT w.*, x.role, x.text, x.r, nxt, CASE
        WHEN x.pos IS NOT NULL AND now.c = 2 + skip.c THEN 'D' WHEN now.c = 5 + put.c THEN 'I'
        WHEN x.pos IS NULL THEN NULL WHEN x.fault IN (1, 2) THEN NULL
        WHEN (r = nxt OR (r = 's' AND w.st = 'e')) AND now.c = keep.c + 5 * (fault = 3)::INT THEN 'K' ELSE 'R' END AS letter
    FROM (SELECT *, CASE st WHEN 'u' THEN 'a' ELSE 'u' END AS nxt FROM walk) w
    LEFT JOIN coded x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.pos = w.pos
    JOIN cost now ON now.conv_id IS NOT DISTINCT FROM w.conv_id AND now.pos = w.pos AND now.st = w.st
    JOIN cost put ON put.conv_id IS NOT DISTINCT FROM w.conv_id AND put.pos = w.pos AND put.st = w.nxt
    LEFT JOIN cost skip ON skip.conv_id IS NOT DISTINCT FROM w.conv_id AND skip.pos = w.pos + 1 AND skip.st = w.st
    LEFT JOIN cost keep ON keep.conv_id IS NOT DISTINCT FROM w.conv_id AND keep.pos = w.pos + 1 AND keep.st = x.r)
  WHERE letter IS NOT NULL),
paths AS (SELECT conv_id, max_by(audit, length(audit)) AS audit, max_by(lines, length(audit)) AS lines FROM walk GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 1)::INT) AS blank,
    sum((fault = 2)::INT) AS duplicate, sum((fault = 3)::INT) AS truncated,
    sum((before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM coded GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN paths ON paths.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN back ON back.conv_id IS NOT DISTINCT FROM o.conv_id AND back.pos = 0
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of the contract's damage: dropped, emptied, without end marks, repeated or with role user, by a checksum."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))
    return rows.where("h <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


@query("op13_path_ranked_repair", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least repair of every conversation after the contract's damage."""
    conversations = table(spark, sf_dir, "conversations")
    _, summary = structure.repair(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    found = summary.withColumnRenamed("conv_id", "_conv")
    joined = every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


OP12_SQL = r"""
WITH pieces AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents)),
runs AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) ks(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS MATERIALIZED (
  SELECT c.*, cut, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score
  FROM (SELECT *, array_to_string(w[: cut], ' ') AS head, array_to_string(w[cut + 1 :], ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)) c
  JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' ') AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
  WHERE longer.a IS NULL OR 100 * longer.a < 50 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op12_tiled_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two or three words that occur together more than apart."""
    return collocations.mine(table(spark, sf_dir, "documents"))
