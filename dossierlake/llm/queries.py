"""One thin query an operator, with production parameters over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.llm import (
    fill_middle,
    kmeans_tree,
    license_scan,
    lm_scoring,
    mixing,
    mtree,
    packing,
    pii,
    quality,
    record_files,
    record_source,
    simhash,
    site_tree,
    whitening,
)
from dossierlake.llm.common import held_out, tokenizer_path, word_count
from dossierlake.workspace import spread_table, table


#: Words of an n-gram at most. README has the figures of 3, which takes more memory than the check tool allows.
LM_ORDER = 2


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    scored = lm_scoring.score_documents(docs, train_on=~held_out("doc_id", 10), order=LM_ORDER)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


#: Scores from here on count as label 1.
QUALITY_FROM = 0.3


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    net = quality.fit(docs, labels, "quality", train_on=~held_out("doc_id", 5))
    scored = quality.score(docs, net)
    predicted = (F.col("score") >= QUALITY_FROM).cast("int")
    return scored.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", predicted.alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread_table(spark, sf_dir, "documents"), words=3, radius=3)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, placed = packing.pack_documents(
        spread_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, drops_blanks=True
    )
    digests = pieces.select("piece", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return digests.join(placed, "piece").drop("piece")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    mixed = mixing.mix_sources(docs, word_count(F.col("text"))).withColumn("size", word_count(F.col("text")))
    taken = F.col("size") * F.col("copies")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


OP5_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
placed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((place - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS bound
  FROM placed),
filled AS (
  SELECT *, bound / weight AS ratio,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget,
         sum(bound) OVER (ORDER BY bound / weight) AS held,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY bound / weight) AS free,
         sum(weight) OVER () AS all_weight
  FROM weighed),
last AS (
  SELECT ratio, held, free FROM filled
  WHERE free > 0 AND held + ratio * free <= budget ORDER BY ratio DESC LIMIT 1),
targets AS (
  SELECT source, source_size,
         least(bound, weight * coalesce((budget - (SELECT held FROM last)) / (SELECT free FROM last),
                                        budget / all_weight)) AS target
  FROM filled),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
budgets AS (SELECT *, target - whole * source_size AS rest FROM rests),
grouped AS (SELECT source, h, sum(size) AS own FROM sizes GROUP BY source, h),
summed AS (
  SELECT source, h, own, sum(own) OVER (PARTITION BY source ORDER BY h) AS upto FROM grouped),
bounds AS (
  SELECT b.source, min(s.h) AS h, min_by(s.own, s.h) AS own, min_by(s.upto - s.own, s.h) AS below
  FROM budgets b JOIN summed s ON s.source IS NOT DISTINCT FROM b.source AND s.upto > b.rest
  GROUP BY b.source)
SELECT z.doc_id, z.size, b.source_size, b.target,
       z.size * least(2, b.whole + CASE WHEN e.h IS NULL OR z.h < e.h
                                          OR (z.h = e.h AND e.below + e.own - b.rest < b.rest - e.below)
                                        THEN 1 ELSE 0 END) AS taken,
       least(2, b.whole + CASE WHEN e.h IS NULL OR z.h < e.h
                                 OR (z.h = e.h AND e.below + e.own - b.rest < b.rest - e.below)
                               THEN 1 ELSE 0 END) AS copies
FROM sizes z
JOIN budgets b ON z.source IS NOT DISTINCT FROM b.source
LEFT JOIN bounds e ON z.source IS NOT DISTINCT FROM e.source
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan(spread_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("matches.dice"), F.lit(0.0)).alias("best_dice"),
    )


def _license_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    rows = ", ".join(f"({k}, {quoted(i)}, {quoted(t)})" for k, (i, t) in enumerate(license_scan.TEMPLATES))
    anchors = ", ".join(f"({quoted(w)}, {t}, {p})" for w, t, p in license_scan.anchors())
    return rf"""
WITH anchors(word, template, place) AS (VALUES {anchors}),
templates AS (
  SELECT template, license, len(w) AS words,
         list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS grams
  FROM (SELECT template, license, regexp_extract_all(lower(body), '[a-z0-9]+') AS w
        FROM (VALUES {rows}) AS t(template, license, body))),
plain AS (
  SELECT row_number() OVER () AS id, doc_id,
         string_split(trim(regexp_replace(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'),
                                          '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
  FROM documents),
each AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM plain),
starts AS (SELECT DISTINCT id, template, i - place AS start FROM each JOIN anchors USING (word)),
windows AS (
  SELECT id, template, license, grams, w, greatest(start, 1) AS first, least(start + words - 1, len(w)) AS last
  FROM starts JOIN templates USING (template) JOIN plain USING (id)),
grams AS (
  SELECT id, template, license, grams, first, last,
         list_distinct(list_transform(range(first, last), lambda i: w[i] || ' ' || w[i + 1])) AS own
  FROM windows WHERE last > first),
scored AS (
  SELECT id, template, license, first, last,
         2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice
  FROM grams),
best AS (
  SELECT * FROM scored WHERE dice >= {license_scan.THRESHOLD}::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY id, template ORDER BY dice DESC, first) = 1),
kept AS (
  SELECT * FROM best s WHERE NOT EXISTS (
    SELECT 1 FROM best o WHERE o.id = s.id AND o.first <= s.last AND s.first <= o.last
      AND (o.dice > s.dice OR (o.dice = s.dice AND (o.license > s.license
           OR (o.license = s.license AND (-o.first > -s.first
               OR (o.first = s.first AND (o.last > s.last OR (o.last = s.last AND o.template > s.template))))))))))
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses,
       coalesce(best_dice, 0.0::DOUBLE) AS best_dice
FROM plain LEFT JOIN (
  SELECT id, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best_dice
  FROM kept GROUP BY id) USING (id)
"""


OP6_SQL = _license_sql()


#: Whoever publishes a corpus keeps a key of their own.
SURROGATE_KEY = b"dossierlake surrogates"


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, SURROGATE_KEY).select("doc_id", "n_entities", "text")


def op8_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


OP8_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS code
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
asked AS (SELECT DISTINCT vec_id, code FROM usable WHERE vec_id % 20 = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.code, c.code), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM asked q JOIN usable c ON q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = record_files.new_folder(spark)
    docs = spread_table(spark, sf_dir, "documents")
    files = record_files.write_token_files(docs, folder, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    read = record_files.read_token_files(spark, folder, files)
    return read.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def read_records_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second quarter of all records by place, through the data source: no other record is read."""
    folder = record_files.new_folder(spark)
    docs = spread_table(spark, sf_dir, "documents")
    files = record_files.write_token_files(docs, folder, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    count = files.agg(F.sum("records")).first()[0] or 0
    place = F.col("place")
    found = record_source.records(spark, folder, files).where((place >= count // 4) & (place < count // 2))
    return found.select("place", "doc_id", (F.octet_length("ids") > 0).alias("filled"))


RECORDS_BY_RANGE_SQL = """
SELECT place, doc_id, TRUE AS filled FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM documents)
WHERE place >= n // 4 AND place < n // 2
"""


def op11_site_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_tree.extract_text(spread_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32).drop("eigenvalue")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.fill_in_middle(spread_table(spark, sf_dir, "documents").select("doc_id", "text"))
    parts = done.select("doc_id", "fim.*")
    digests = [
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    ]
    return parts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n,
         list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(digest, i, 8))::BIGINT) AS h
  FROM cut),
placed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50
              THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
         array_to_string(units[high + 1:n], '') AS suffix
  FROM placed)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
