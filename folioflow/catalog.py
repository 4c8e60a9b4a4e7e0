"""Queries over a corpus directory and, where SQL can say the same, their ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import geometry, hashing, metrics, text
from folioflow.functions.ids import base_name, page_key
from folioflow.operators import evaluation, images, index, lines, manifest, nested, preparation, quality, references, report, sampling, summary
from folioflow.plans.lineage import scratch_folder
from folioflow.sources import archives, files, recognizer
from folioflow.sources.tables import table
from folioflow.streaming import feedback

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


_KEY = "substr(sha256({}), 1, 16)"
_BUCKET = "(('0x' || substr(sha256({}), 1, 16))::UBIGINT % 100)"


@query("stable_bucket", f"SELECT CASE WHEN {_BUCKET.format('document_id')} < 55 THEN 'clean' ELSE 'camera' END AS variant, count(*) AS n FROM documents GROUP BY 1")
def stable_bucket(spark: SparkSession, at: str) -> DataFrame:
    kind = F.when(hashing.bucket(F.col("document_id")) < 55, "clean").otherwise("camera")
    return table(spark, at, "documents").groupBy(kind.alias("variant")).agg(F.count("*").alias("n"))


_SPLIT = """
SELECT doc_id, CASE WHEN n > 1 AND place <= greatest(1, round_even(n * 0.1, 0)) THEN 'dev' ELSE 'train' END AS assigned, lang
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY g ORDER BY sha256(g || ':' || doc_id), doc_id) AS place, count(*) OVER (PARTITION BY g) AS n
      FROM (SELECT doc_id, lang, coalesce(category, 'unknown') AS g FROM documents))
"""


@query("stratified_split", f"SELECT doc_id, assigned FROM ({_SPLIT})")
def stratified_split(spark: SparkSession, at: str) -> DataFrame:
    return sampling.stratified_split(table(spark, at, "documents").select("doc_id", "category"), "doc_id", "category").select("doc_id", "assigned")


@query("split_counts", f"SELECT lang, assigned, count(*) AS n FROM ({_SPLIT}) GROUP BY ALL")
def split_counts(spark: SparkSession, at: str) -> DataFrame:
    rows = sampling.stratified_split(table(spark, at, "documents").select("doc_id", "category", "lang"), "doc_id", "category")
    return report.histogram(rows, ["lang", "assigned"])


@query("threshold_tags", """
SELECT row_id, concat_ws(',', CASE WHEN place <= 2 THEN 'smoke' END, CASE WHEN place <= 10 THEN 'regression' END, CASE WHEN place <= 50 THEN 'research' END) AS tags
FROM (SELECT row_id, row_number() OVER (PARTITION BY category ORDER BY sha256('seed:' || row_id)) AS place FROM manifest)
""")  # fmt: skip
def threshold_tags(spark: SparkSession, at: str) -> DataFrame:
    tagged = sampling.threshold_tags(table(spark, at, "manifest"), "row_id", "category")
    return tagged.select("row_id", F.array_join("tags", ",").alias("tags"))


_SLOTS = {name: pattern.replace("'", "''") for name, pattern in sampling.SLOTS}
_SLOT_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS slot FROM documents WHERE regexp_matches(text, '{pattern}')" for name, pattern in _SLOTS.items())
_SLOT_TOP = f"SELECT slot, doc_id, rank FROM (SELECT slot, doc_id, row_number() OVER (PARTITION BY slot ORDER BY sha256(slot || ':' || doc_id), doc_id) AS rank FROM ({_SLOT_ROWS})) WHERE rank <= 10"


def _slotted(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").select("doc_id", sampling.slot_candidates(F.coalesce("text", F.lit(""))).alias("slots"))


@query("slot_candidates", f"SELECT slot, count(*) AS n FROM ({_SLOT_ROWS}) GROUP BY 1")
def slot_candidates(spark: SparkSession, at: str) -> DataFrame:
    return _slotted(spark, at).select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))


@query("slot_topk", _SLOT_TOP)
def slot_topk(spark: SparkSession, at: str) -> DataFrame:
    return sampling.slot_sample(_slotted(spark, at), "doc_id", "slots")


@query("review_topk", f"SELECT doc_id FROM (SELECT DISTINCT doc_id FROM ({_SLOT_TOP})) ORDER BY sha256('review:' || doc_id) LIMIT 8")
def review_topk(spark: SparkSession, at: str) -> DataFrame:
    chosen = slot_topk(spark, at).select("doc_id").distinct()
    return sampling.top_by_hash(chosen, 8, "review", F.col("doc_id").cast("string")).select("doc_id")


@query("capped_selection", """
SELECT row_id, source_split FROM manifest WHERE source_split = 'validation'
UNION ALL (SELECT row_id, source_split FROM manifest WHERE source_split = 'training' ORDER BY sha256('capped:' || row_id) LIMIT 2000)
""")  # fmt: skip
def capped_selection(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "manifest").select("row_id", "source_split")
    capped = sampling.top_by_hash(rows.filter("source_split = 'training'"), 2000, "capped", F.col("row_id").cast("string")).drop("rank")
    return rows.filter("source_split = 'validation'").unionByName(capped)


_TURNS = f"SELECT row_id, coalesce(category, 'unknown') AS category, sample_count, row_number() OVER (PARTITION BY coalesce(category, 'unknown') ORDER BY {_KEY.format('row_id::VARCHAR')}, row_id) AS turn, {_KEY.format('row_id::VARCHAR')} AS h FROM manifest"


@query("balanced_sample", f"SELECT row_id, row_number() OVER (ORDER BY turn, category, h, row_id) AS position FROM (SELECT * FROM ({_TURNS}) ORDER BY turn, category, h, row_id LIMIT 500)")
def balanced_sample(spark: SparkSession, at: str) -> DataFrame:
    return sampling.balanced_sample(table(spark, at, "manifest"), "row_id", "category", 500).select("row_id", "position")


@query("budget_sample", f"""
SELECT row_id, sample_count, preceding FROM (
  SELECT row_id, sample_count, coalesce(sum(sample_count) OVER (ORDER BY turn, category, h, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS preceding
  FROM ({_TURNS.replace('FROM manifest', 'FROM manifest WHERE sample_count > 0')})
) WHERE preceding < 2000
""")  # fmt: skip
def budget_sample(spark: SparkSession, at: str) -> DataFrame:
    return sampling.budget_sample(table(spark, at, "manifest"), "row_id", "category", "sample_count", 2000).select("row_id", "sample_count", "preceding")


def _capped(part: str, n: int) -> str:
    return f"(SELECT row_id, '{part}' AS part FROM ({_TURNS.replace('FROM manifest', f'FROM manifest WHERE dataset_split = {chr(39)}{part}{chr(39)}')}) ORDER BY turn, category, h, row_id LIMIT {n})"


@query("capped_train_dev", f"SELECT * FROM {_capped('train', 270)} UNION ALL SELECT * FROM {_capped('dev', 30)}")
def capped_train_dev(spark: SparkSession, at: str) -> DataFrame:
    return sampling.capped_train_dev(table(spark, at, "manifest"), "row_id", "category", "dataset_split", 300).select("row_id", "part")


@query("final_topn", "SELECT row_id, row_number() OVER (ORDER BY sha256('final:' || coalesce(category, 'unknown') || ':' || row_id)) AS rank FROM (SELECT row_id, category FROM manifest WHERE dataset_split = 'final' ORDER BY sha256('final:' || coalesce(category, 'unknown') || ':' || row_id) LIMIT 120)")
def final_topn(spark: SparkSession, at: str) -> DataFrame:
    final = table(spark, at, "manifest").filter("dataset_split = 'final'")
    return sampling.top_by_hash(final, 120, "final", F.concat_ws(":", F.coalesce("category", F.lit("unknown")), F.col("row_id").cast("string"))).select("row_id", "rank")


_INDEX = 'SELECT row_id, "end" - n AS first, "end" FROM (SELECT row_id, sample_count::BIGINT AS n, (sum(sample_count) OVER (ORDER BY row_id))::BIGINT AS "end" FROM manifest WHERE sample_count > 0)'


@query("prefix_index", _INDEX)
def prefix_index(spark: SparkSession, at: str) -> DataFrame:
    return index.prefix_index(table(spark, at, "manifest"), "row_id", "sample_count")


@query("sample_locate", f'SELECT event_id, row_id, event_id - first AS place FROM events JOIN ({_INDEX}) ON event_id >= first AND event_id < "end"')
def sample_locate(spark: SparkSession, at: str) -> DataFrame:
    asked = table(spark, at, "events").select("event_id")
    return index.locate(prefix_index(spark, at), "row_id", asked, "event_id")


def _batches(epoch: int, world: int, size: int, resume: int) -> str:
    return f"""
WITH o AS (SELECT row_id, sample_count AS n, row_number() OVER (ORDER BY sha256('epoch:{epoch}:' || row_id), row_id) - 1 AS turn FROM manifest WHERE sample_count > 0),
m AS (SELECT row_id, n, turn % {world} AS rank, (sum(n) OVER (PARTITION BY turn % {world} ORDER BY turn) - n)::BIGINT AS b FROM o),
p AS (SELECT rank, row_id, n, b, unnest(range(b // {size}, (b + n - 1) // {size} + 1)) AS batch FROM m)
SELECT rank::INT AS rank, batch, row_id, greatest(0, batch * {size} - b)::BIGINT AS first, (least(n, (batch + 1) * {size} - b) - 1)::BIGINT AS last
FROM p JOIN (SELECT rank, sum(n) // {size} AS whole FROM m GROUP BY 1) USING (rank) WHERE batch < whole AND batch >= {resume}
"""


@query("epoch_batches", _batches(3, 4, 64, 0))
def epoch_batches(spark: SparkSession, at: str) -> DataFrame:
    return index.rank_batches(table(spark, at, "manifest").select("row_id", "sample_count"), "row_id", "sample_count", 3, 4, 64)


@query("resume_batches", _batches(4, 2, 128, 10))
def resume_batches(spark: SparkSession, at: str) -> DataFrame:
    return index.rank_batches(table(spark, at, "manifest").select("row_id", "sample_count"), "row_id", "sample_count", 4, 2, 128, resume=10)


_HASHED = "(('0x' || substr(sha256('stream-retry:' || split || ':' || number || ':' || a), 1, 16))::UBIGINT % total)::BIGINT"


@query("replacement_probe", f"""
WITH RECURSIVE s AS (SELECT row_id - 1 AS number, coalesce(annotation_count > 2, false) AS valid, coalesce(dataset_split, 'none') AS split FROM manifest), t AS (SELECT count(*) AS total FROM s),
h AS (SELECT number, a, total, {_HASHED} AS c FROM s, t, range(1, 32) r(a) WHERE NOT valid),
p AS (
  SELECT number, 0::BIGINT AS a, [number] AS tried FROM s WHERE NOT valid
  UNION ALL SELECT p.number, h.a, list_append(p.tried, (h.c + coalesce(list_filter(range(0, least(len(p.tried), h.total - 1) + 1), lambda k: NOT list_contains(p.tried, (h.c + k) % h.total))[1], 0)) % h.total)
  FROM p JOIN h ON h.number = p.number AND h.a = p.a + 1
),
c AS (SELECT number, a AS attempt, tried[-1] AS used FROM p WHERE a > 0)
SELECT number, number AS used, 0 AS attempt FROM s WHERE valid
UNION ALL SELECT s.number, arg_min(used, attempt), min(attempt)::INT FROM s LEFT JOIN (SELECT c.* FROM c JOIN s g ON g.number = c.used AND g.valid) h USING (number) WHERE NOT s.valid GROUP BY 1
""")  # fmt: skip
def replacement_probe(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "manifest").select((F.col("row_id") - 1).alias("number"), F.coalesce(F.col("annotation_count") > 2, F.lit(False)).alias("valid"), F.coalesce("dataset_split", F.lit("none")).alias("split"))
    return index.replaced(rows, "number", "valid", "split", rows.count())


@query("batch_count", """
SELECT 'dropped' AS kind, greatest(0, (coalesce(sum(sample_count) FILTER (sample_count > 0), 0) // 4) // 64 - 3)::BIGINT AS batches FROM manifest
UNION ALL SELECT 'kept', greatest(0, ceil((coalesce(sum(sample_count) FILTER (sample_count > 0), 0) // 4) / 64) - 3)::BIGINT FROM manifest
""")
def batch_count(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "manifest").select("sample_count")
    kind = lambda drop, name: index.batch_count(rows, "sample_count", 4, 64, 3, drop).select(F.lit(name).alias("kind"), "batches")
    return kind(True, "dropped").unionAll(kind(False, "kept"))


_STEM = "lower(regexp_replace(regexp_replace(replace({0}, '\\', '/'), '^[^/]+/(.)', '\\1'), '([^/])\\.[^./]+$', '\\1'))"
_BASE = "regexp_extract(replace({0}, '\\', '/'), '[^/]*$')"


@query("relative_stem", f"SELECT row_id, {_STEM.format('image_member')} AS stem, {_BASE.format('image_member')} AS base FROM manifest")
def relative_stem(spark: SparkSession, at: str) -> DataFrame:
    path = F.col("image_member")
    return table(spark, at, "manifest").select("row_id", manifest.relative_stem(path).alias("stem"), base_name(manifest.slashed(path)).alias("base"))


_IMAGES = "(SELECT DISTINCT member_path FROM archive_members WHERE kind = 'image')"


@query("pair_two_stage", f"""
WITH s AS (SELECT {_STEM.format('member_path')} AS stem FROM {_IMAGES} GROUP BY 1), b AS (SELECT {_BASE.format('member_path')} AS base FROM {_IMAGES} GROUP BY 1 HAVING count(*) = 1)
SELECT CASE WHEN s.stem IS NOT NULL THEN 'relative_stem' WHEN b.base IS NOT NULL THEN 'file_name' ELSE 'missing' END AS paired_by, count(*) AS n
FROM manifest m LEFT JOIN s ON s.stem = {_STEM.format('m.label_member')} LEFT JOIN b ON b.base = {_BASE.format('m.image_member')} GROUP BY 1
""")  # fmt: skip
def pair_two_stage(spark: SparkSession, at: str) -> DataFrame:
    images = table(spark, at, "archive_members").filter("kind = 'image'").select("member_path").distinct()
    rows = table(spark, at, "manifest").select("row_id", "label_member", base_name(manifest.slashed(F.col("image_member"))).alias("declared"))
    return manifest.pair_labels(rows, images, "label_member", "declared", "member_path").groupBy("paired_by").agg(F.count("*").alias("n"))


@query("pair_last_wins", f"""
WITH l AS (SELECT {_BASE.format('member_path')} AS name, arg_max(zip_path, (added_at, zip_path)) AS image FROM archive_members WHERE kind = 'image' GROUP BY 1)
SELECT row_id, image FROM manifest JOIN l ON name = {_BASE.format('image_member')}
""")  # fmt: skip
def pair_last_wins(spark: SparkSession, at: str) -> DataFrame:
    images = table(spark, at, "archive_members").filter("kind = 'image'").select(base_name(manifest.slashed(F.col("member_path"))).alias("name"), "zip_path", "added_at")
    rows = table(spark, at, "manifest").select("row_id", base_name(manifest.slashed(F.col("image_member"))).alias("declared"))
    return manifest.pair_by_name(rows, images, "declared", "name", "zip_path", "added_at").select("row_id", "image")


@query("unmatched_both", """
SELECT 'manifest' AS side, id FROM (SELECT id FROM manifest EXCEPT SELECT document_id FROM documents) WHERE id IS NOT NULL
UNION ALL SELECT 'documents', document_id FROM (SELECT document_id FROM documents EXCEPT SELECT id FROM manifest) WHERE document_id IS NOT NULL
""")  # fmt: skip
def unmatched_both(spark: SparkSession, at: str) -> DataFrame:
    return manifest.unmatched(table(spark, at, "manifest"), table(spark, at, "documents").withColumnRenamed("document_id", "id"), "id", ("manifest", "documents"))


@query("leakage_check", "SELECT author FROM documents WHERE dataset_split IN ('train', 'final') GROUP BY 1 HAVING count(DISTINCT dataset_split) > 1 AND author IS NOT NULL")
def leakage_check(spark: SparkSession, at: str) -> DataFrame:
    return manifest.leaked_keys(table(spark, at, "documents").filter("author is not null"), "author", "dataset_split", "train", "final", None)


@query("duplicate_ids", "SELECT id, count(*) AS copies FROM manifest GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, at: str) -> DataFrame:
    return manifest.duplicates(table(spark, at, "manifest"), ["id"])


_SHORT = f"regexp_replace({_BASE.format('image_member')}, '(.)\\.[^.]+$', '\\1')"


@query("id_disambiguation", f"""
SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY {_SHORT} ORDER BY row_id) = 1 THEN {_SHORT} ELSE replace({_STEM.format('image_member')}, '/', '__') END AS document_id
FROM manifest WHERE image_member <> ''
""")  # fmt: skip
def id_disambiguation(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "manifest").select("row_id", "image_member").filter("image_member <> ''")
    return manifest.disambiguate(rows, "image_member", ["row_id"]).select("row_id", "document_id")


_LABEL = "trim(regexp_replace(nfc_normalize(coalesce(annotation.text, '')), '[\\s\\p{Z}]+', ' ', 'g'))"
_SOUND = "(annotation.bbox IS NOT NULL AND len(annotation.bbox) = 4 AND coalesce(isfinite(annotation.bbox[1]) AND isfinite(annotation.bbox[2]) AND isfinite(annotation.bbox[3]) AND isfinite(annotation.bbox[4]) AND annotation.bbox[3] >= 2 AND annotation.bbox[4] >= 2, false))"
_REASON = f"CASE WHEN {_LABEL} = '' THEN 'empty' WHEN length({_LABEL}) > 25 THEN 'too_long' WHEN NOT {_SOUND} THEN 'invalid_bbox' ELSE 'valid' END"


@query("reason_counts", f"SELECT {_REASON} AS reason, count(*) AS n FROM annotations GROUP BY 1")
def reason_counts(spark: SparkSession, at: str) -> DataFrame:
    return manifest.rejection_counts(table(spark, at, "annotations"))


@query("validity_filter", f"SELECT document_id, count(*) AS annotations, count(*) FILTER ({_REASON} = 'valid') AS samples FROM annotations GROUP BY 1")
def validity_filter(spark: SparkSession, at: str) -> DataFrame:
    return manifest.sample_counts(table(spark, at, "annotations"), "document_id")


@query("split_contract", """
SELECT source_split, dataset_split, count(*) AS n FROM manifest
WHERE dataset_split IS NOT NULL AND NOT coalesce((source_split, dataset_split) IN (('training', 'train'), ('training', 'dev'), ('validation', 'final')), false) GROUP BY ALL
""")  # fmt: skip
def split_contract(spark: SparkSession, at: str) -> DataFrame:
    return manifest.split_violations(table(spark, at, "manifest"), "source_split", "dataset_split")


@query("nested_nav", "SELECT event_type, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS total FROM events GROUP BY 1")
def nested_nav(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("int")).alias("total"))


@query("reference_text", """
SELECT document_id, count(*) AS n, string_agg(t, ' ' ORDER BY id, ann_key, t) AS reference
FROM (SELECT DISTINCT document_id, coalesce(id, 0) AS id, ann_key, coalesce(annotation.text, '') AS t FROM annotations) GROUP BY 1
""")  # fmt: skip
def reference_text(spark: SparkSession, at: str) -> DataFrame:
    return manifest.reference_text(table(spark, at, "annotations"), "document_id")


@query("manifest_statistics", """
SELECT label_zip, count(*) AS rows, count(DISTINCT id) AS pages, count(*) FILTER (trim(coalesce(image_member, '')) = '') AS without_image,
  count(*) FILTER (trim(coalesce(label_member, '')) = '') AS without_label, sum(annotation_count)::BIGINT AS annotations, sum(sample_count)::BIGINT AS samples FROM manifest GROUP BY 1
""")  # fmt: skip
def manifest_statistics(spark: SparkSession, at: str) -> DataFrame:
    return manifest.manifest_statistics(table(spark, at, "manifest"))


@query("manifest_examples", "SELECT row_id, label_zip FROM manifest WHERE image_member IS NULL ORDER BY label_zip, row_id LIMIT 20")
def manifest_examples(spark: SparkSession, at: str) -> DataFrame:
    return manifest.examples(table(spark, at, "manifest"), F.col("image_member").isNull(), ["label_zip", "row_id"]).select("row_id", "label_zip")


_SEEN = "length(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g'))"
_LINES = "(SELECT DISTINCT analysis_id, line_id, text, confidence, x, y, width, height FROM ocr_line_data)"


def _page_lines(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "ocr_line_data").select("analysis_id", "line_id", "text", "confidence", "x", "y", "width", "height").distinct()


@query("words_to_lines", f"""
SELECT analysis_id, string_agg(text, ' ' ORDER BY line_id, text) AS text, round(sum(confidence::DECIMAL(18, 6) * greatest(1, {_SEEN}))::DOUBLE / sum(greatest(1, {_SEEN})), 2) AS confidence,
  min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, min(line_id) AS first
FROM {_LINES} WHERE trim(text) <> '' AND confidence >= 0 GROUP BY 1
""")  # fmt: skip
def words_to_lines(spark: SparkSession, at: str) -> DataFrame:
    return lines.words_to_lines(_page_lines(spark, at), ["analysis_id"], "line_id", "text")


@query("weighted_confidence", f"SELECT analysis_id, count(*) AS n, round(sum(confidence::DECIMAL(18, 6) * greatest(1, {_SEEN}))::DOUBLE / sum(greatest(1, {_SEEN})), 6) AS confidence FROM ocr_line GROUP BY 1")
def weighted_confidence(spark: SparkSession, at: str) -> DataFrame:
    return lines.weighted_confidence(table(spark, at, "ocr_line"), ["analysis_id"])


@query("reading_order", f"""
WITH RECURSIVE p AS (SELECT analysis_id, greatest(3.0::DOUBLE, median(greatest(1, height)) * 0.55::DOUBLE) AS tol FROM {_LINES} GROUP BY 1),
i AS (SELECT analysis_id, line_id, x, y, y + height / 2.0::DOUBLE AS c, row_number() OVER (PARTITION BY analysis_id ORDER BY y + height / 2.0::DOUBLE, x, line_id) AS k FROM {_LINES}),
f AS (
  SELECT analysis_id, k, line_id, x, y, 1 AS r, c AS s, 1 AS n FROM i WHERE k = 1
  UNION ALL
  SELECT i.analysis_id, i.k, i.line_id, i.x, i.y, CASE WHEN abs(i.c - f.s / f.n) <= tol THEN f.r ELSE f.r + 1 END,
    CASE WHEN abs(i.c - f.s / f.n) <= tol THEN f.s + i.c ELSE i.c END, CASE WHEN abs(i.c - f.s / f.n) <= tol THEN f.n + 1 ELSE 1 END
  FROM f JOIN i ON i.analysis_id = f.analysis_id AND i.k = f.k + 1 JOIN p ON p.analysis_id = f.analysis_id
),
t AS (SELECT *, min(y) OVER (PARTITION BY analysis_id, r) AS top FROM f)
SELECT analysis_id, line_id, dense_rank() OVER (PARTITION BY analysis_id ORDER BY top, r) AS row, row_number() OVER (PARTITION BY analysis_id ORDER BY top, r, x, y, line_id) AS place FROM t
""")  # fmt: skip
def reading_order(spark: SparkSession, at: str) -> DataFrame:
    return lines.reading_order(_page_lines(spark, at), ["analysis_id"], "line_id")


_VALID = "length(regexp_replace(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g'), '[^\\p{L}\\p{N}.,·:;!?%+\\-/()\\[\\]{}<>₩원년월일시분초]', '', 'g'))"


@query("valid_char_ratio", f"SELECT analysis_id, id, round(CASE WHEN {_SEEN} = 0 THEN 0 ELSE {_VALID} / {_SEEN} END, 6) AS ratio FROM ocr_line")
def valid_char_ratio(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "ocr_line").select("analysis_id", "id", F.round(text.valid_ratio(F.col("text")), 6).alias("ratio"))


@query("candidate_score", f"""
SELECT analysis_id, characters, round(v / characters, 6) AS valid_ratio, round(c, 6) AS confidence, round(0.80 * round(c, 6) + 15.0 * v / characters + 5.0 * least(1.0, ln(1 + characters) / ln(501)), 3) AS score
FROM (SELECT analysis_id, sum({_SEEN})::BIGINT AS characters, sum({_VALID})::DOUBLE AS v, sum(confidence::DECIMAL(18, 6) * greatest(1, {_SEEN}))::DOUBLE / sum(greatest(1, {_SEEN})) AS c FROM ocr_line GROUP BY 1)
""")  # fmt: skip
def candidate_score(spark: SparkSession, at: str) -> DataFrame:
    return lines.score_pages(table(spark, at, "ocr_line"), ["analysis_id"])


@query("choose_candidate", """
SELECT user_id, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value + CASE WHEN event_type = 'view' THEN 3.0 ELSE 0.0 END DESC, event_id) AS place FROM events
) WHERE place = 1
""")  # fmt: skip
def choose_candidate(spark: SparkSession, at: str) -> DataFrame:
    return lines.choose_candidate(table(spark, at, "events"), ["user_id"], "event_type", "value", "event_id", "view").select("user_id", "event_type", "event_id")


_K = "json_extract_string(props, '$.k')::INT"


@query("candidate_routing", f"""
SELECT event_id, concat_ws(',', CASE WHEN value < 72 OR k / 1000.0 >= 0.055 THEN 'normalized' END, CASE WHEN value < 72 THEN CASE WHEN k / 2000.0 <= 0.035 THEN 'sparse' ELSE 'block' END END,
  CASE WHEN value < 72 AND k / 1000.0 >= 0.075 THEN 'binary' END) AS strategies FROM (SELECT event_id, value, {_K} AS k FROM events)
""")  # fmt: skip
def candidate_routing(spark: SparkSession, at: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, at, "events").select("event_id", F.array_join(lines.extra_strategies(F.col("value"), k / 2000, k / 1000), ",").alias("strategies"))


@query("quality_verdict", f"""
SELECT event_id, CASE WHEN b OR (value < 80 AND k / 4.0 < 12) THEN 'retake' ELSE 'pass' END AS verdict, concat_ws(',', CASE WHEN b THEN 'blank' END, CASE WHEN value < 80 THEN 'blur' END, CASE WHEN k / 4.0 < 12 THEN 'low_contrast' END) AS reasons
FROM (SELECT event_id, value, k, k / 100.0 < 0.001 OR k / 100.0 > 0.70 AS b FROM (SELECT event_id, value, {_K} AS k FROM events))
""")  # fmt: skip
def quality_verdict(spark: SparkSession, at: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    seen = (k / 100, F.col("value"), k / 4)
    return table(spark, at, "events").select("event_id", quality.verdict(*seen).alias("verdict"), F.array_join(quality.reasons(*seen), ",").alias("reasons"))


_NOSPACE = "regexp_replace({0}, '[\\s\\p{{Z}}]+', '', 'g')"


@query("char_error_rate", f"SELECT p_partkey, round(levenshtein({_NOSPACE.format('p_type')}, {_NOSPACE.format('p_name')}) / length({_NOSPACE.format('p_type')}), 6) AS cer FROM part")
def char_error_rate(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "part").select("p_partkey", F.round(metrics.character_error_rate(F.col("p_type"), F.col("p_name")), 6).alias("cer"))


def _token_rate(a: str, b: str) -> str:
    """Word error rate: tokens as one character each, by their place among the distinct tokens of both texts."""
    words = lambda t: f"regexp_extract_all({t}, '\\S+')"
    coded = lambda t: f"list_aggregate(list_transform({words(t)}, lambda w: chr(33 + list_position(list_distinct(list_concat({words(a)}, {words(b)})), w)::INT)), 'string_agg', '')"
    return f"CASE WHEN len({words(a)}) = 0 THEN (len({words(b)}) > 0)::INT::DOUBLE ELSE levenshtein(coalesce({coded(a)}, ''), coalesce({coded(b)}, '')) / len({words(a)}) END"


@query("word_error_rate", f"SELECT p_partkey, round({_token_rate('r', 'p_name')}, 6) AS wer FROM (SELECT p_partkey, p_name, p_type || ' ' || p_name AS r FROM part)")
def word_error_rate(spark: SparkSession, at: str) -> DataFrame:
    both = table(spark, at, "part").select("p_partkey", text.words(F.concat_ws(" ", "p_type", "p_name")).alias("r"), text.words(F.col("p_name")).alias("h"))
    return both.select("p_partkey", F.round(metrics.word_error_rate(F.col("r"), F.col("h")), 6).alias("wer"))


def _multiset(source: str, key: str, a: str, b: str, pattern: str) -> str:
    return f"""
WITH t AS (SELECT {key}, unnest(regexp_extract_all(lower({a}), '{pattern}')) AS t, 1 AS r, 0 AS h FROM {source} UNION ALL SELECT {key}, unnest(regexp_extract_all(lower({b}), '{pattern}')), 0, 1 FROM {source}),
c AS (SELECT {key}, t, sum(r) AS r, sum(h) AS h FROM t GROUP BY ALL), s AS (SELECT {key}, sum(least(r, h)) AS m, sum(r) AS r, sum(h) AS h FROM c GROUP BY 1),
f AS (SELECT {key}, coalesce(m, 0)::BIGINT AS matched, coalesce(r, 0)::BIGINT AS refs, coalesce(h, 0)::BIGINT AS hyps FROM (SELECT {key} FROM {source}) LEFT JOIN s USING ({key})),
g AS (SELECT *, CASE WHEN hyps = 0 THEN (refs = 0)::INT::DOUBLE ELSE matched / hyps END AS p, CASE WHEN refs = 0 THEN (hyps = 0)::INT::DOUBLE ELSE matched / refs END AS q FROM f)
SELECT {key}, matched, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM g
"""


@query("word_f1", _multiset("part", "p_partkey", "p_type || ' ' || p_name", "p_name || ' ' || p_brand", "[\\p{L}\\p{N}]+"))
def word_f1(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("r"), F.concat_ws(" ", "p_name", "p_brand").alias("h"))
    return metrics.word_scores(rows, ["p_partkey"], "r", "h").select("p_partkey", "matched", F.round("f1", 6).alias("f1"))


@query("numeric_f1", _multiset("feedback", "id", "created_at", "analysis_id", "\\d+(?:[.,:/-]\\d+)*%?"))
def numeric_f1(spark: SparkSession, at: str) -> DataFrame:
    return metrics.numeric_scores(table(spark, at, "feedback"), ["id"], "created_at", "analysis_id").select("id", "matched", F.round("f1", 6).alias("f1"))


@query("score_bundle", f"""
SELECT p_partkey, round(levenshtein({_NOSPACE.format('p_type')}, {_NOSPACE.format('p_name')}) / length({_NOSPACE.format('p_type')}), 4) AS cer, round({_token_rate('p_type', 'p_name')}, 4) AS wer,
  round(p_retailprice, 2) AS ms, length({_NOSPACE.format('p_name')}) AS characters, round(w.f1, 4) AS word_f1, round(n.f1, 4) AS numeric_f1
FROM part JOIN ({_multiset('part', 'p_partkey', 'p_type', 'p_name', '[\\p{L}\\p{N}]+')}) w USING (p_partkey) JOIN ({_multiset('part', 'p_partkey', 'p_type', 'p_name', '\\d+(?:[.,:/-]\\d+)*%?')}) n USING (p_partkey)
""")
def score_bundle(spark: SparkSession, at: str) -> DataFrame:
    return metrics.score_bundle(table(spark, at, "part"), ["p_partkey"], "p_type", "p_name", "p_retailprice")


@query("length_ratio_flag", f"""
SELECT p_partkey, ratio, cer > 1.0 AND raw >= 2.0 AS flagged FROM (
  SELECT p_partkey, length({_NOSPACE.format('p_name')}) / length({_NOSPACE.format('p_brand')}) AS raw, round(length({_NOSPACE.format('p_name')}) / length({_NOSPACE.format('p_brand')}), 3) AS ratio,
    round(levenshtein({_NOSPACE.format('p_brand')}, {_NOSPACE.format('p_name')}) / length({_NOSPACE.format('p_brand')}), 4) AS cer FROM part)
""")  # fmt: skip
def length_ratio_flag(spark: SparkSession, at: str) -> DataFrame:
    ratio = text.visible_count(F.col("p_name")) / text.visible_count(F.col("p_brand"))
    flagged = (F.round(metrics.character_error_rate(F.col("p_brand"), F.col("p_name")), 4) > 1.0) & (ratio >= 2.0)
    return table(spark, at, "part").select("p_partkey", F.round(ratio, 3).alias("ratio"), flagged.alias("flagged"))


_MARKED = "'# ' || lang || chr(10) || '- **' || coalesce(source, '') || '** [' || document_id || '](x) <b>' || coalesce(category, '') || '</b> ![i](y)'"


@query("strip_markup", f"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKED}, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'),
  '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]+>', ' ', 'g'), '(?m)^\\s{{0,3}}#{{1,6}}\\s*', '', 'g'), '(?m)^\\s*[-+>]\\s+', '', 'g'), '[`*_~|]+', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS plain FROM documents
""")  # fmt: skip
def strip_markup(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "documents").select("doc_id", text.markdown_text(F.expr(_MARKED)).alias("plain"))


@query("profile_report", f"""
SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_rate, round(median(value), 4) AS median_rate, count(*) FILTER (k > 90) AS flagged,
  round(avg(value) FILTER (NOT k > 90), 4) AS mean_unflagged, round(avg(k), 4) AS mean_k FROM (SELECT *, {_K} AS k FROM events) GROUP BY 1
""")  # fmt: skip
def profile_report(spark: SparkSession, at: str) -> DataFrame:
    return report.profile_report(_events(spark, at), "event_type", "value", F.col("k") > 90, {"mean_k": "k"})


def _events(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@query("strategy_histogram", f"SELECT event_type, {_K} % 5 AS strategy, count(*) AS n FROM events GROUP BY ALL")
def strategy_histogram(spark: SparkSession, at: str) -> DataFrame:
    return report.histogram(_events(spark, at).withColumn("strategy", F.col("k") % 5), ["event_type", "strategy"])


@query("condition_report", f"""
SELECT event_type, light, deformation, CASE WHEN grouping(light) = 0 THEN 'light' WHEN grouping(deformation) = 0 THEN 'deformation' ELSE 'all' END AS level, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median
FROM (SELECT event_type, value, user_id % 7 AS light, {_K} % 3 AS deformation FROM events) GROUP BY GROUPING SETS ((event_type), (light, event_type), (deformation, event_type))
""")  # fmt: skip
def condition_report(spark: SparkSession, at: str) -> DataFrame:
    rows = _events(spark, at).select("event_type", "value", (F.col("user_id") % 7).alias("light"), (F.col("k") % 3).alias("deformation"))
    return report.condition_report(rows, "event_type", ["light", "deformation"], "value")


_MEANS = f"(SELECT user_id, event_type, round(avg(value), 6) AS value, round(avg({_K}), 6) AS k, count(*) AS n FROM events GROUP BY ALL)"


def _means(spark: SparkSession, at: str) -> DataFrame:
    return _events(spark, at).groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("value"), F.round(F.avg("k"), 6).alias("k"), F.count("*").alias("n"))


@query("effects_vs_base", f"""
SELECT v.event_type, count(*) AS documents, round(round(avg(v.value), 4) - round(avg(b.value), 4), 4) AS gain, count(*) FILTER (v.value > b.value) AS wins, count(*) FILTER (v.value < b.value) AS losses
FROM {_MEANS} v JOIN {_MEANS} b ON v.user_id = b.user_id AND b.event_type = 'view' WHERE v.event_type <> 'view' GROUP BY 1
""")  # fmt: skip
def effects_vs_base(spark: SparkSession, at: str) -> DataFrame:
    return report.effects(_means(spark, at), "user_id", "event_type", "view", "value")


_RULES = {"always_base": "false", "always_other": "true", "higher_k": "o.k > b.k", "more_events": "o.n > b.n", "best": "o.value > b.value"}


@query("selector_report", " UNION ALL ".join(f"""
SELECT '{rule}' AS rule, round(avg(CASE WHEN {pick} THEN o.value ELSE b.value END), 4) AS mean, count(*) FILTER ({pick}) AS picks, count(*) FILTER (({pick}) = (o.value > b.value)) AS agreements, count(*) AS documents
FROM {_MEANS} b JOIN {_MEANS} o ON b.user_id = o.user_id WHERE b.event_type = 'view' AND o.event_type = 'click'
""" for rule, pick in _RULES.items()))  # fmt: skip
def selector_report(spark: SparkSession, at: str) -> DataFrame:
    rules = {"always_base": None, "always_other": None, "higher_k": "k", "more_events": "n", "best": "value"}
    return report.selectors(_means(spark, at), "user_id", "event_type", "view", "click", "value", rules)


@query("recognition_report", f"SELECT count(*) AS n, round(avg(levenshtein({_NOSPACE.format('p_type')}, {_NOSPACE.format('p_name')}) / length({_NOSPACE.format('p_type')})), 4) AS mean_rate, round(avg((p_type = p_name)::INT), 4) AS exact, round(avg(p_retailprice), 4) AS mean_confidence FROM part")
def recognition_report(spark: SparkSession, at: str) -> DataFrame:
    return report.recognition_report(table(spark, at, "part"), "p_type", "p_name", "p_retailprice", metrics.character_error_rate(F.col("p_type"), F.col("p_name")))


@query("length_percentiles", f"""
WITH l AS (SELECT length({_LABEL}) AS v FROM annotations), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM l WHERE v > 0)
SELECT count(*) AS labels, round(avg(v), 3) AS mean, max(v) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95, max(v) FILTER (i = round_even(0.99 * (n - 1), 0)) AS p99, max(v) AS longest,
  count(*) FILTER (v > 25) AS over, (SELECT count(*) FROM l WHERE v = 0) AS empty FROM o
""")  # fmt: skip
def length_percentiles(spark: SparkSession, at: str) -> DataFrame:
    lengths = table(spark, at, "annotations").select(F.length(text.label_text(F.col("annotation.text"))).alias("v"))
    return report.length_profile(lengths, "v")


_FIELDS = ("category", "id", "row_id", "sample_count")
_ROW = "sha256('{' || concat_ws(',', " + ", ".join(f"'\"{c}\":' || coalesce(to_json({c})::VARCHAR, 'null')" for c in _FIELDS) + ") || '}')"


@query("table_fingerprint", "SELECT count(*) AS rows, sha256(concat_ws('-', count(*), " + ", ".join(f"sum(('0x' || substr(d, {1 + 12 * i}, 12))::UBIGINT)" for i in range(5)) + f")) AS fingerprint FROM (SELECT {_ROW} AS d FROM manifest)")
def table_fingerprint(spark: SparkSession, at: str) -> DataFrame:
    return hashing.table_fingerprint(table(spark, at, "manifest"), list(_FIELDS))


_PAD = "greatest(2, round_even({0} * 0.06, 0))::BIGINT"
_B = ["annotation.bbox[1]", "annotation.bbox[2]", "annotation.bbox[3]", "annotation.bbox[4]"]


@query("crop_rect", f"""
SELECT * FROM (SELECT ann_key, greatest(0, floor({_B[0]})::BIGINT - {_PAD.format(_B[2])}) AS "left", greatest(0, floor({_B[1]})::BIGINT - {_PAD.format(_B[3])}) AS "top",
  least(1240, ceil({_B[0]} + {_B[2]})::BIGINT + {_PAD.format(_B[2])}) AS "right", least(1754, ceil({_B[1]} + {_B[3]})::BIGINT + {_PAD.format(_B[3])}) AS "bottom"
  FROM (SELECT DISTINCT * FROM annotations) WHERE {_SOUND}) WHERE "right" - "left" >= 2 AND "bottom" - "top" >= 2
""")  # fmt: skip
def crop_rect(spark: SparkSession, at: str) -> DataFrame:
    box = F.col("annotation.bbox")
    rows = table(spark, at, "annotations").distinct().filter((F.size(box) == 4))
    rectangle = geometry.crop_rectangle(*(F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4)), F.lit(1240), F.lit(1754))
    return rows.select("ann_key", rectangle.alias("_r")).filter("_r is not null").select("ann_key", "_r.*")


_H = [1.02, 0.015, -8.0, -0.01, 0.99, 5.0, 0.00001, 0.00002, 1.0]


def _projected(u: str, v: str, row: int) -> str:
    a, b, c = _H[3 * row : 3 * row + 3]
    return f"round(({a}::DOUBLE * ({u}) + {b}::DOUBLE * ({v}) + {c}::DOUBLE) / ({_H[6]}::DOUBLE * ({u}) + {_H[7]}::DOUBLE * ({v}) + {_H[8]}::DOUBLE), 6)"


_CORNERS = [("bbox.x", "bbox.y"), ("bbox.x + bbox.width", "bbox.y"), ("bbox.x + bbox.width", "bbox.y + bbox.height"), ("bbox.x", "bbox.y + bbox.height")]
_PX, _PY = (", ".join(_projected(u, v, r) for u, v in _CORNERS) for r in (0, 1))


@query("project_boxes", f"""
SELECT analysis_id, id, l AS x, t AS y, greatest(1, r - l) AS width, greatest(1, b - t) AS height FROM (
  SELECT analysis_id, id, greatest(0, least(1653, floor(least({_PX}))::BIGINT)) AS l, greatest(0, least(2338, floor(least({_PY}))::BIGINT)) AS t,
    greatest(0, least(1654, ceil(greatest({_PX}))::BIGINT)) AS r, greatest(0, least(2339, ceil(greatest({_PY}))::BIGINT)) AS b FROM ocr_line)
""")  # fmt: skip
def project_boxes(spark: SparkSession, at: str) -> DataFrame:
    box = geometry.project_box(*(F.col(f"bbox.{c}").cast("double") for c in ("x", "y", "width", "height")), _H, 1654, 2339)
    return table(spark, at, "ocr_line").select("analysis_id", "id", box.alias("_b")).select("analysis_id", "id", "_b.*")


_NUMBERED = "(SELECT analysis_id, text, row_number() OVER (PARTITION BY analysis_id ORDER BY id, text) AS i FROM (SELECT DISTINCT analysis_id, id, coalesce(text, '') AS text FROM ocr_line))"


@query("numbered_prompt", f"SELECT analysis_id, string_agg('[' || i || '] ' || text, chr(10) ORDER BY i) AS prompt FROM {_NUMBERED} GROUP BY 1")
def numbered_prompt(spark: SparkSession, at: str) -> DataFrame:
    return summary.page_lines(table(spark, at, "ocr_line"), ["analysis_id"], "id").select("analysis_id", summary.numbered_prompt(F.col("lines")).alias("prompt"))


@query("fallback_summary", f"""
WITH u AS (SELECT analysis_id, i, trim(text) AS t, row_number() OVER (PARTITION BY analysis_id ORDER BY i) AS n FROM {_NUMBERED} WHERE text <> ''),
a AS (SELECT analysis_id, i, row_number() OVER (PARTITION BY analysis_id ORDER BY i) AS m FROM u WHERE regexp_matches(t, '신청|접수|제출|문의|기간')),
b AS (SELECT analysis_id, string_agg(i, ',' ORDER BY i) AS actions, count(*) AS na FROM a WHERE m <= 4 GROUP BY 1)
SELECT analysis_id, substr(max(t) FILTER (n = 1), 1, 80) AS title, substr(string_agg(t, ' ' ORDER BY n) FILTER (n <= 3), 1, 500) AS overview,
  coalesce(string_agg(i, ',' ORDER BY n) FILTER (n BETWEEN 2 AND 5), '') AS points, coalesce(any_value(actions), '') AS actions, 100.0::DOUBLE AS coverage
FROM u LEFT JOIN b USING (analysis_id) GROUP BY 1
""")  # fmt: skip
def fallback_summary(spark: SparkSession, at: str) -> DataFrame:
    made = summary.extractive_summary(summary.page_lines(table(spark, at, "ocr_line"), ["analysis_id"], "id"))
    cited = lambda c: F.array_join(F.transform(c, lambda f: f["ids"][0].cast("string")), ",")
    return made.select("analysis_id", "title", "overview", cited("key_points").alias("points"), cited("actions").alias("actions"), summary.citation_coverage(F.col("overview_ids"), F.col("key_points"), F.col("actions")).alias("coverage"))


@query("clean_citations", """
SELECT analysis_id, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS ids FROM (
  SELECT analysis_id, unnest([id % 7, id % 7, id * 3]) AS c, count(*) OVER (PARTITION BY analysis_id) AS n FROM (SELECT DISTINCT analysis_id, id FROM ocr_line)
) WHERE c BETWEEN 1 AND n GROUP BY 1
""")  # fmt: skip
def clean_citations(spark: SparkSession, at: str) -> DataFrame:
    pages = table(spark, at, "ocr_line").select("analysis_id", "id").distinct().groupBy("analysis_id").agg(F.flatten(F.collect_list(F.array(F.col("id") % 7, F.col("id") % 7, F.col("id") * 3))).alias("c"), F.count("*").alias("n"))
    cleaned = pages.withColumn("c", summary.clean_ids(F.col("c"), F.col("n")))
    return cleaned.filter(F.size("c") > 0).select("analysis_id", F.array_join(F.transform("c", lambda i: i.cast("string")), ",").alias("ids"))


@query("feedback_valid", """
SELECT coalesce(CASE WHEN NOT coalesce(length(analysis_id), 0) BETWEEN 1 AND 64 THEN 'invalid_id' WHEN coalesce(accepted, 0) = 0 AND trim(coalesce(corrected_text, '')) = '' THEN 'missing_correction'
  WHEN length(corrected_text) > 100000 THEN 'too_long' END, 'valid') AS problem, count(*) AS n FROM feedback GROUP BY 1
""")  # fmt: skip
def feedback_valid(spark: SparkSession, at: str) -> DataFrame:
    problem = files.feedback_problem(F.col("analysis_id"), F.col("accepted"), F.col("corrected_text"))
    return table(spark, at, "feedback").groupBy(F.coalesce(problem, F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


@query("windowed_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, at: str) -> DataFrame:
    return feedback.windowed_counts(table(spark, at, "events"), "ts", "event_type", "value")


@query("branch_metrics", """
SELECT strategy, metric, value FROM (SELECT strategy, round(avg(confidence), 4) AS confidence, round(avg(width), 4) AS width, round(avg(length(text)), 4) AS characters FROM ocr_line_data GROUP BY 1)
UNPIVOT (value FOR metric IN (confidence, width, characters))
""")  # fmt: skip
def branch_metrics(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "ocr_line_data").withColumn("characters", F.length("text"))
    return report.branch_metrics(rows, "strategy", {"confidence": "confidence", "width": "width", "characters": "characters"})


_OBJECTS = """
o AS (SELECT label_id, scanned_at, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN t::JSON END AS o FROM (
  SELECT label_id, scanned_at, regexp_replace(CASE WHEN starts_with(b, '"') AND json_valid(b) THEN json_extract_string(b, '$') ELSE b END, '^[\\s\\x{FEFF}]+', '') AS t
  FROM (SELECT label_id, scanned_at, regexp_replace(payload, '^[\\s\\x{FEFF}]+', '') AS b FROM label_records) WHERE b <> ''))
"""


def _places(name: str, source: str, field: str, place: str) -> str:
    keep = "label_id" if source == "o" else "label_id, node"
    items = f"CASE json_type({field}) WHEN 'ARRAY' THEN {field}::JSON[] WHEN 'OBJECT' THEN [{field}] ELSE [] END"
    each = f"SELECT {keep}, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT {keep}, {items} AS l FROM {source})"
    return f"{name} AS (SELECT label_id, {place} AS node, x FROM ({each}) WHERE json_type(x) = 'OBJECT')"


_FLAT = f"""
WITH {_OBJECTS}, {_places('images', 'o', "(o->'images')", 'i::VARCHAR')}, {_places('notes', 'o', "(o->'annotations')", 'i::VARCHAR')},
{_places('words', 'notes', "(x->'annotation.words')", "node || '.' || i")}, {_places('others', 'words', "(x->'alternatives')", "node || '.' || i")}
"""
_CLEAN = "lower(nfc_normalize(replace({0}, '\\', '/')))"
_ORPHANS = f"""
WITH {_OBJECTS}, f AS (SELECT label_id, scanned_at, regexp_extract(replace(CASE json_type(o->'images') WHEN 'ARRAY' THEN json_extract_string(o, '$.images[0]."image.file.name"') ELSE json_extract_string(o, '$.images."image.file.name"') END, '\\', '/'), '[^/]*$') AS name FROM o),
r AS (
  SELECT 'manifest.image_member' AS ref_field, row_id, scanned_at, 'image|' || lower(image_zip) || '|' || {_CLEAN.format('image_member')} AS k FROM manifest WHERE trim(image_member) <> ''
  UNION ALL SELECT 'manifest.label_member', row_id, scanned_at, 'label|' || lower(label_zip) || '|' || {_CLEAN.format('label_member')} FROM manifest WHERE trim(label_member) <> ''
  UNION ALL SELECT 'image.file.name', label_id, scanned_at, 'name|' || lower(nfc_normalize(name)) FROM f WHERE trim(name) <> ''),
m AS (
  SELECT kind || '|' || lower(zip_path) || '|' || {_CLEAN.format('member_path')} AS k, added_at, deleted_at FROM archive_members
  UNION ALL SELECT 'name|' || regexp_extract({_CLEAN.format('member_path')}, '[^/]*$'), added_at, deleted_at FROM archive_members WHERE kind = 'image'),
s AS (SELECT ref_field, row_id, scanned_at, count(added_at) AS n, coalesce(bool_or(added_at <= scanned_at AND (deleted_at IS NULL OR deleted_at > scanned_at)), false) AS alive, coalesce(bool_or(added_at > scanned_at), false) AS comes
  FROM r LEFT JOIN m USING (k) GROUP BY ALL)
SELECT ref_field, row_id, strftime(scanned_at, '%Y-%m') AS ref_month, CASE WHEN n = 0 THEN 'missing' WHEN comes THEN 'late' ELSE 'deleted' END AS ref_state FROM s WHERE NOT alive
"""


@query("p3_found", _ORPHANS)
def p3_found(spark: SparkSession, at: str) -> DataFrame:
    return references.orphan_references(table(spark, at, "manifest"), table(spark, at, "label_records"), table(spark, at, "archive_members"))


@query("p3_report", f"SELECT ref_field, ref_month, ref_state, count(*) AS n_refs FROM ({_ORPHANS}) GROUP BY ALL")
def p3_report(spark: SparkSession, at: str) -> DataFrame:
    return references.orphan_report(p3_found(spark, at))


@query("p4_found", _FLAT + "SELECT label_id, 'images' AS child, node FROM images UNION ALL SELECT label_id, 'annotations', node FROM notes UNION ALL SELECT label_id, 'words', node FROM words UNION ALL SELECT label_id, 'alternatives', node FROM others")
def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return nested.nodes(table(spark, at, "label_records"))


_PARENT = "CASE WHEN contains(node, '.') THEN regexp_replace(node, '\\.[^.]*$', '') END AS parent"
_TEXT = "json_extract_string(x, '$.\"{0}\"') AS {1}"
_NO_PARENT = "NULL::VARCHAR AS parent"
_LEVEL_SQL = {
    "images": f"{_FLAT} SELECT label_id, node, {_NO_PARENT}, {_TEXT.format('image.file.name', 'file_name')}, {_TEXT.format('image.category', 'category')}, {_TEXT.format('image.width', 'width')}, {_TEXT.format('image.capture', 'capture')} FROM images",
    "annotations": f"{_FLAT} SELECT label_id, node, {_NO_PARENT}, {_TEXT.format('id', 'id')}, {_TEXT.format('annotation.text', 'text')}, {_TEXT.format('annotation.bbox', 'bbox')}, {_TEXT.format('annotation.review', 'review')} FROM notes",
    "words": f"{_FLAT} SELECT label_id, node, {_PARENT}, {_TEXT.format('word', 'word')}, {_TEXT.format('conf', 'conf')} FROM words",
    "alternatives": f"{_FLAT} SELECT label_id, node, {_PARENT}, {_TEXT.format('word', 'word')}, {_TEXT.format('score', 'score')} FROM others",
}


def _level(level: str) -> Query:
    return lambda spark, at: nested.flatten(table(spark, at, "label_records"), level)


for _name in nested.LEVELS:
    query(f"p4_{_name}", _LEVEL_SQL.get(_name))(_level(_name))


_BOX = "try_cast(json_extract(x, '$.\"annotation.bbox\"') AS DOUBLE[])"
_NOTE = "trim(regexp_replace(nfc_normalize(coalesce(json_extract_string(x, '$.\"annotation.text\"'), '')), '[\\s\\p{Z}]+', ' ', 'g'))"
_EXAMINED = f"""
{_FLAT},
g AS (SELECT label_zip, label_member, min(label_id) AS label_id FROM label_records GROUP BY ALL),
u AS (SELECT label_id, count(*) FILTER (n <> '' AND length(n) <= 25 AND len(b) = 4 AND coalesce(isfinite(b[1]) AND isfinite(b[2]) AND isfinite(b[3]) AND isfinite(b[4]) AND b[3] >= 2 AND b[4] >= 2, false)) AS samples
  FROM (SELECT label_id, {_NOTE} AS n, {_BOX} AS b FROM notes) GROUP BY 1),
e AS (SELECT label_id, CASE json_type(o->'images') WHEN 'ARRAY' THEN o->'images'->0 WHEN 'OBJECT' THEN o->'images' END AS i,
  CASE json_type(o->'annotations') WHEN 'ARRAY' THEN json_array_length(o->'annotations')::INT WHEN 'OBJECT' THEN 1 ELSE 0 END AS annotation_count FROM o WHERE o IS NOT NULL),
h AS (SELECT label_id, coalesce(json_type(i) = 'OBJECT', false) AS has_image, json_extract_string(i, '$."image.file.name"') AS file_name, json_extract_string(i, '$."image.category"') AS category, annotation_count FROM e),
m AS (SELECT member_path, min(zip_path) AS zip FROM archive_members WHERE kind = 'image' AND trim(member_path) <> '' GROUP BY 1),
ms AS (SELECT {_STEM.format('member_path')} AS stem, min(member_path) AS path FROM m GROUP BY 1),
mb AS (SELECT {_BASE.format('member_path')} AS base, min(member_path) AS path FROM m GROUP BY 1 HAVING count(*) = 1),
x AS (SELECT g.label_zip, g.label_member, h.*, coalesce(u.samples, 0)::INT AS sample_count, coalesce(ms.path, mb.path) AS image_member,
  CASE WHEN has_image IS NULL THEN 'invalid_label' WHEN NOT has_image THEN 'no_image_record' WHEN coalesce(ms.path, mb.path) IS NULL THEN 'missing_image' ELSE 'paired' END AS outcome
  FROM g LEFT JOIN h USING (label_id) LEFT JOIN u USING (label_id) LEFT JOIN ms ON ms.stem = {_STEM.format('g.label_member')} LEFT JOIN mb ON mb.base = {_BASE.format('h.file_name')})
"""
_NAMED = f"""
, k AS (SELECT x.*, zip AS image_zip, regexp_replace({_BASE.format("coalesce(file_name, '')")}, '(.)\\.[^.]+$', '\\1') AS short FROM x JOIN m ON m.member_path = image_member WHERE outcome = 'paired'),
d AS (SELECT * REPLACE (coalesce(category, 'unknown') AS category), CASE WHEN short <> '' AND row_number() OVER (PARTITION BY short ORDER BY label_zip, label_member) = 1 THEN short ELSE replace({_STEM.format('label_member')}, '/', '__') END AS id FROM k),
v AS (SELECT *, concat_ws(':', id, label_zip, label_member) AS key FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256(category || ':' || key), key) AS place, count(*) OVER (PARTITION BY category) AS n FROM v)
"""


def _examined(spark: SparkSession, at: str) -> DataFrame:
    return preparation.examined_labels(table(spark, at, "label_records"), table(spark, at, "archive_members"))


@query("build_manifest", f"""{_EXAMINED}{_NAMED}
SELECT id, category, 'training' AS source_split, CASE WHEN n > 1 AND place <= greatest(1, round_even(n * 0.1, 0)) THEN 'dev' ELSE 'train' END AS dataset_split, image_zip, image_member, label_zip, label_member, annotation_count, sample_count FROM w
""")  # fmt: skip
def build_manifest(spark: SparkSession, at: str) -> DataFrame:
    return preparation.build_manifest(_examined(spark, at), "training").drop("splits")


@query("build_report", f"""{_EXAMINED}
SELECT o AS measure, count(x.outcome) AS n FROM (SELECT unnest(['invalid_label', 'no_image_record', 'missing_image', 'paired']) AS o) LEFT JOIN x ON x.outcome = o GROUP BY 1
UNION ALL SELECT 'labels_seen', count(*) FROM x UNION ALL SELECT 'images_indexed', count(*) FROM m
UNION ALL SELECT 'ambiguous_names', count(*) FROM (SELECT {_BASE.format('member_path')} FROM m GROUP BY 1 HAVING count(*) > 1)
""")
def build_report(spark: SparkSession, at: str) -> DataFrame:
    return preparation.build_report(_examined(spark, at), table(spark, at, "archive_members"))


@query("build_examples", f"{_EXAMINED} SELECT label_zip, label_member FROM x WHERE outcome = 'missing_image' ORDER BY label_zip, label_member LIMIT 20")
def build_examples(spark: SparkSession, at: str) -> DataFrame:
    return preparation.build_examples(_examined(spark, at), "missing_image")


@query("benchmark_manifest", f"""
WITH t AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY sha256('seed:' || doc_id)) AS place FROM documents),
s AS (SELECT doc_id, string_agg(slot, ',' ORDER BY slot) AS slots FROM ({_SLOT_ROWS}) GROUP BY 1), b AS (SELECT doc_id, string_agg(slot, ',' ORDER BY slot) AS bench FROM ({_SLOT_TOP}) GROUP BY 1),
r AS (SELECT doc_id FROM b ORDER BY sha256('golden:' || doc_id) LIMIT 8)
SELECT doc_id, concat_ws(',', CASE WHEN place <= 2 THEN 'smoke' END, CASE WHEN place <= 10 THEN 'regression' END, CASE WHEN place <= 50 THEN 'research' END) AS splits,
  coalesce(slots, '') AS slot_candidates, coalesce(bench, '') AS slot_benchmark, doc_id IN (SELECT doc_id FROM r) AS golden_review_candidate
FROM t LEFT JOIN s USING (doc_id) LEFT JOIN b USING (doc_id)
""")
def benchmark_manifest(spark: SparkSession, at: str) -> DataFrame:
    made = preparation.benchmark_manifest(table(spark, at, "documents").select("doc_id", "category", "text"), "text", "doc_id")
    return made.select("doc_id", F.array_join("splits", ",").alias("splits"), F.array_join(F.array_sort("slot_candidates"), ",").alias("slot_candidates"), F.array_join("slot_benchmark", ",").alias("slot_benchmark"), "golden_review_candidate")


_SUMMARY = "'{\"annotation\":{\"corrected_summary\":' || CASE WHEN annotation_count IS NULL THEN 'null' ELSE '{\"corrected_type5\":{\"errors\":[' || repeat('{\"type\":\"x\"},', annotation_count) || '{\"type\":\"y\"}]},\"corrected_all\":{\"text\":\"' || coalesce(category, '') || '\"}}' END || '}}'"


@query("summary_rows", "SELECT row_id, coalesce(annotation_count + 1, 0) AS error_count, annotation_count IS NOT NULL AND coalesce(category, '') <> '' AS has_corrected_all FROM manifest")
def summary_rows(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "manifest").select("row_id", F.expr(_SUMMARY).alias("payload"))
    return preparation.summary_rows(rows, "payload").drop("payload")


@query("sample_indexes", """
WITH t AS (SELECT row_id, id, coalesce(category, 'unknown') AS category, sample_count, dataset_split FROM manifest WHERE source_split = 'training' AND sample_count > 0),
a AS (SELECT 'train' AS part, row_id, (sum(sample_count) OVER (ORDER BY row_id))::BIGINT AS "end", sample_count FROM t WHERE dataset_split = 'train'),
h AS (SELECT *, substr(sha256(concat_ws(':', 'dev', category, id)), 1, 16) AS h FROM t WHERE dataset_split = 'dev'),
b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h, row_id) AS turn FROM h),
c AS (SELECT 'dev' AS part, row_id, (sum(sample_count) OVER (ORDER BY turn, category, h, row_id))::BIGINT AS "end", sample_count FROM b)
SELECT part, row_id, "end" - sample_count AS first, "end" FROM a UNION ALL SELECT part, row_id, "end" - sample_count, "end" FROM c WHERE "end" - sample_count < 1000
""")
def sample_indexes(spark: SparkSession, at: str) -> DataFrame:
    return preparation.sample_indexes(table(spark, at, "manifest").filter("source_split = 'training'"), "row_id", 1000)


@query("training_samples", f"""
WITH k AS (SELECT id AS document_id, min(row_id) AS row_id FROM manifest WHERE id IS NOT NULL GROUP BY 1),
r AS (SELECT DISTINCT document_id, ann_key, id, annotation FROM annotations WHERE document_id IS NOT NULL),
c AS (SELECT document_id, ann_key, id, {_LABEL} AS label, greatest(0, floor({_B[0]})::BIGINT - {_PAD.format(_B[2])}) AS "left", greatest(0, floor({_B[1]})::BIGINT - {_PAD.format(_B[3])}) AS "top",
  least(1654, ceil({_B[0]} + {_B[2]})::BIGINT + {_PAD.format(_B[2])}) AS "right", least(2339, ceil({_B[1]} + {_B[3]})::BIGINT + {_PAD.format(_B[3])}) AS "bottom" FROM r WHERE {_REASON} = 'valid'),
n AS (SELECT row_id, c.*, row_number() OVER (PARTITION BY document_id ORDER BY id NULLS FIRST, ann_key NULLS FIRST, label, "left", "top") - 1 AS place FROM c JOIN k USING (document_id) WHERE "right" - "left" >= 2 AND "bottom" - "top" >= 2),
s AS (SELECT *, row_number() OVER (ORDER BY row_id, place) - 1 AS number, CASE WHEN {_BUCKET.format("'variant:' || document_id || ':' || coalesce(id, place)")} < 45 THEN 'camera' ELSE 'clean' END AS variant FROM n)
SELECT event_id, row_id, place, ann_key, label, "left", "top", "right", "bottom", variant, {_KEY.format("concat_ws(':', document_id, coalesce(id, place), variant, '3')")} AS seed FROM s JOIN events ON event_id = number
""")
def training_samples(spark: SparkSession, at: str) -> DataFrame:
    keys = table(spark, at, "manifest").filter("id is not null").groupBy(F.col("id").alias("document_id")).agg(F.min("row_id").alias("row_id"))
    numbered = preparation.numbered_samples(table(spark, at, "annotations"), "document_id").join(keys, "document_id")
    made = preparation.training_samples(table(spark, at, "events").select("event_id"), "event_id", numbered, "document_id", "row_id", 3)
    return made.select("event_id", "row_id", "place", "ann_key", "label", "left", "top", "right", "bottom", "variant", "seed")


@query("not_subset", "SELECT document_id FROM (SELECT DISTINCT document_id FROM documents WHERE document_id IS NOT NULL) WHERE document_id NOT IN (SELECT id FROM manifest WHERE id IS NOT NULL)")
def not_subset(spark: SparkSession, at: str) -> DataFrame:
    return preparation.not_subset(table(spark, at, "documents"), table(spark, at, "manifest").select(F.col("id").alias("document_id")), "document_id")


_RECORDS = f"(SELECT event_type, value / 100 AS cer, value / 90 AS wer, value / 110 AS word_f1, value / 120 AS numeric_f1, value AS model_confidence, value * 3 AS ocr_ms, k, k > 90 AS review FROM (SELECT *, {_K} AS k FROM events))"


def _records(spark: SparkSession, at: str) -> DataFrame:
    value = F.col("value")
    rates = {"cer": 100, "wer": 90, "word_f1": 110, "numeric_f1": 120}
    rows = _events(spark, at).select("event_type", "k", *((value / n).alias(c) for c, n in rates.items()), value.alias("model_confidence"), (value * 3).alias("ocr_ms"))
    return rows.withColumn("alignment_review_required", F.col("k") > 90)


def _avg(column: str, digits: int = 4, name: str | None = None) -> str:
    return f"round(avg({column}::DECIMAL(20, 6)), {digits}) AS mean_{name or column}"


@query("profile_aggregate", f"""
SELECT event_type, count(*) AS documents, {_avg('cer')}, round(median(cer), 4) AS median_cer, {_avg('wer')}, {_avg('word_f1')}, {_avg('numeric_f1')}, {_avg('model_confidence', 2)}, {_avg('ocr_ms', 2)},
  count(*) FILTER (review) AS alignment_review_required, round(avg(cer) FILTER (NOT review), 4) AS mean_cer_without_review_flags FROM {_RECORDS} GROUP BY 1
""")
def profile_aggregate(spark: SparkSession, at: str) -> DataFrame:
    return evaluation.profile_aggregate(_records(spark, at), "event_type")


@query("variant_aggregate", f"""
SELECT event_type, CASE WHEN grouping(light) = 0 THEN 'light' WHEN grouping(deformation) = 0 THEN 'deformation' ELSE 'all' END AS level, coalesce(light, deformation)::VARCHAR AS value, count(*) AS documents,
  {_avg('cer', name='reading_order_cer')}, round(median(cer), 4) AS median_reading_order_cer, {_avg('wer', name='word_precision')}, {_avg('cer', name='word_recall')}, {_avg('word_f1')}, {_avg('numeric_f1')}, {_avg('model_confidence')}, {_avg('ocr_ms', 2)},
  count(*) FILTER (k % 2 = 0) AS rectified, count(*) FILTER (k % 3 = 0) AS illumination_normalized
FROM (SELECT *, k % 7 AS light, k % 5 AS deformation FROM {_RECORDS}) GROUP BY GROUPING SETS ((event_type), (light, event_type), (deformation, event_type))
""")
def variant_aggregate(spark: SparkSession, at: str) -> DataFrame:
    rows = _records(spark, at).withColumns({"reading_order_cer": F.col("cer"), "word_precision": F.col("wer"), "word_recall": F.col("cer"), "rectified": F.col("k") % 2 == 0, "illumination_normalized": F.col("k") % 3 == 0, "light": F.col("k") % 7, "deformation": F.col("k") % 5})
    return evaluation.variant_aggregate(rows, "event_type", ["light", "deformation"])


@query("model_aggregate", f"SELECT count(*) AS documents, {_avg('cer')}, {_avg('wer')}, {_avg('word_f1')}, {_avg('numeric_f1')}, {_avg('ocr_ms', 2, 'ms')} FROM {_RECORDS}")
def model_aggregate(spark: SparkSession, at: str) -> DataFrame:
    return evaluation.model_aggregate(_records(spark, at).withColumnRenamed("ocr_ms", "elapsed_ms"))


def _recognised(spark: SparkSession, at: str) -> DataFrame:
    """Each recognised page of ocr_line_data with the text of its annotations."""
    lines_of = table(spark, at, "ocr_line_data").select("volume_id", "page_no", "strategy", "analysis_id", "line_id", "text", "confidence").distinct()
    pages = evaluation.recognized_text(lines_of.withColumn("page", F.concat(page_key(F.col("volume_id")), F.lit("p"), F.lpad(F.col("page_no").cast("string"), 3, "0"))), ["page", "strategy", "analysis_id"])
    notes = manifest.reference_text(table(spark, at, "annotations").withColumn("page", page_key(F.col("document_id"))), "page").select("page", "reference")
    return pages.join(notes, "page")


@query("evaluate_pages")
def evaluate_pages(spark: SparkSession, at: str) -> DataFrame:
    return evaluation.measured(_recognised(spark, at), ["page", "strategy", "analysis_id"]).drop("reference", "hypothesis")


@query("evaluate_report")
def evaluate_report(spark: SparkSession, at: str) -> DataFrame:
    return evaluation.profile_aggregate(evaluate_pages(spark, at).withColumn("ocr_ms", F.lit(0.0)), "strategy")


_MANIFEST_FIELDS = "id, category, source_split, dataset_split, image_zip, image_member, label_zip, label_member, annotation_count, sample_count"


@query("manifest_lines", f"SELECT {_MANIFEST_FIELDS}, list_aggregate(splits, 'string_agg', ',') AS splits FROM manifest")
def manifest_lines(spark: SparkSession, at: str) -> DataFrame:
    """The manifest written as JSON Lines and read back."""
    folder = scratch_folder(spark, "manifest")
    files.write_manifest(table(spark, at, "manifest").drop("row_id", "scanned_at", "received_at"), folder)
    read = files.not_empty(files.read_manifest(spark, folder), "manifest")
    return read.withColumn("splits", F.when(F.size("splits") > 0, F.array_join("splits", ",")))


@query("manifest_cases", f"SELECT id FROM manifest WHERE list_contains(splits, 'smoke')")
def manifest_cases(spark: SparkSession, at: str) -> DataFrame:
    return files.cases(table(spark, at, "manifest"), "smoke").select("id")


_LISTED = "replace(replace(replace(coalesce(annotation.text, ''), chr(9), ' '), chr(10), ' '), chr(13), ' ')"


@query("label_lists", f"""
SELECT strategy, image, label FROM (SELECT CASE WHEN ann_key % 2 = 0 THEN 'camera' ELSE 'clean' END AS strategy, 'images/' || ann_key || '.png' AS image, {_LISTED} AS label FROM (SELECT DISTINCT ann_key, annotation FROM annotations))
""")
def label_lists(spark: SparkSession, at: str) -> DataFrame:
    """Label lists written, one a variant, and read back."""
    folder = scratch_folder(spark, "lists")
    rows = table(spark, at, "annotations").select("ann_key", "annotation").distinct()
    named = rows.select(F.concat(F.lit("images/"), F.col("ann_key").cast("string"), F.lit(".png")).alias("image"), F.translate(F.coalesce("annotation.text", F.lit("")), "\t\n\r", "   ").alias("label"), F.when(F.col("ann_key") % 2 == 0, "camera").otherwise("clean").alias("variant"))
    files.write_label_lists(named, folder)
    parts = [files.read_label_list(spark, f"{folder}/variant={v}").withColumn("strategy", F.lit(v)) for v in ("camera", "clean")]
    return parts[0].unionByName(parts[1])


_REFUSED = "CASE WHEN NOT coalesce(length(analysis_id), 0) BETWEEN 1 AND 64 THEN 'invalid_id' WHEN coalesce(accepted, 0) = 0 AND trim(coalesce(corrected_text, '')) = '' THEN 'missing_correction' WHEN length(corrected_text) > 100000 THEN 'too_long' END"


@query("feedback_table", f"SELECT id, analysis_id, accepted, corrected_text, 2 AS copies FROM feedback WHERE {_REFUSED} IS NULL")
def feedback_table(spark: SparkSession, at: str) -> DataFrame:
    """Feedback appended twice; refused rows are not in the table."""
    folder = scratch_folder(spark, "feedback")
    for _ in range(2):
        files.append_feedback(table(spark, at, "feedback"), folder)
    return spark.read.parquet(folder).groupBy("id", "analysis_id", "accepted", "corrected_text").agg(F.count("*").cast("int").alias("copies"))


def _packed(spark: SparkSession, at: str) -> DataFrame:
    """Label records as ZIP archives in memory (path, content), one a label archive, with images of the same names."""
    import io
    import zipfile

    import pandas as pd

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind, suffix in (("label", ".json"), ("image", ".jpg")):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                for i, payload in zip(frame["label_id"], frame["payload"], strict=True):
                    z.writestr(f"root/{i % 7}/{i}{suffix}", (payload or "").encode() if kind == "label" else b"x")
            rows.append((f"file:/data/{'Training' if i % 2 else 'Validation'}/{kind}/{frame['label_zip'].iloc[0]}", buffer.getvalue()))
        return pd.DataFrame(rows, columns=["path", "content"])

    return table(spark, at, "label_records").select("label_id", "label_zip", "payload").groupBy("label_zip").applyInPandas(pack, "path string, content binary")


@query("packed_archives", """
SELECT k AS kind, count(*) AS archives, sum(n)::BIGINT AS members FROM (SELECT label_zip, count(*) AS n FROM label_records GROUP BY 1), (SELECT unnest(['image', 'label']) AS k) GROUP BY 1
""")
def packed_archives(spark: SparkSession, at: str) -> DataFrame:
    sorts = archives.classify(archives.members(_packed(spark, at)))
    return sorts.groupBy("kind").agg(F.count("*").alias("archives"), F.sum(F.col("images") + F.col("labels")).alias("members"))


@query("packed_labels", "SELECT count(*) AS labels, count(*) FILTER (NOT coalesce(json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload::JSON END) = 'OBJECT', false)) AS broken FROM (SELECT regexp_replace(payload, '^\\x{FEFF}', '') AS payload FROM label_records)")
def packed_labels(spark: SparkSession, at: str) -> DataFrame:
    counted = archives.label_counts(archives.labels(archives.members(_packed(spark, at), payload=True)))
    return counted.agg(F.sum("labels").alias("labels"), F.sum("broken").alias("broken"))


@query("packed_images", "SELECT 'root/' || (label_id % 7) || '/' || label_id || '.jpg' AS member, (label_id % 7) || '/' || label_id AS stem, label_id || '.jpg' AS base, false AS ambiguous, (label_id % 7)::VARCHAR AS template FROM label_records")
def packed_images(spark: SparkSession, at: str) -> DataFrame:
    found = archives.members(_packed(spark, at))
    indexed = archives.image_index(found)
    return indexed.join(archives.photo_groups(found).select("member", "template"), "member").select("member", "stem", "base", "ambiguous", "template")


@query("detector_lines", """
SELECT ann_key, trim(nfc_normalize(t)) AS text, round(greatest(0, least(100, s * 100)), 2) AS confidence FROM (
  SELECT ann_key, unnest([coalesce(annotation.text, ''), ' ', document_id]) AS t, unnest([ann_key % 13 / 10.0, 0.5, NULL]) AS s0, coalesce(s0, 0) AS s FROM (SELECT DISTINCT ann_key, document_id, annotation FROM annotations)
) WHERE trim(nfc_normalize(t)) <> ''
""")
def detector_lines(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "annotations").select("ann_key", "document_id", "annotation").distinct()
    texts = F.array(F.coalesce("annotation.text", F.lit("")), F.lit(" "), F.col("document_id"))
    scores = F.array(F.col("ann_key") % 13 / 10, F.lit(0.5), F.lit(None).cast("double"))
    found = rows.select("ann_key", F.explode(recognizer.detector_lines(texts, scores, F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("_l"))
    return found.select("ann_key", "_l.text", "_l.confidence")


@query("page_crops", f"""
SELECT ann_key, "bottom" - "top" AS height, "right" - "left" AS width, ann_key % 200 AS grey FROM (
  SELECT ann_key, greatest(0, floor({_B[0]} / 20)::BIGINT - 2) AS "left", greatest(0, floor({_B[1]} / 20)::BIGINT - 2) AS "top", least(120, ceil({_B[0]} / 20 + {_B[2]} / 20)::BIGINT + 2) AS "right", least(160, ceil({_B[1]} / 20 + {_B[3]} / 20)::BIGINT + 2) AS "bottom"
  FROM (SELECT DISTINCT ann_key, annotation FROM annotations WHERE ann_key IS NOT NULL) WHERE {_SOUND}) WHERE "right" > "left" AND "bottom" > "top"
""")
def page_crops(spark: SparkSession, at: str) -> DataFrame:
    """Crops of plain grey pages, one page an annotation, on a twentieth of the scale."""
    box = [F.try_element_at("annotation.bbox", F.lit(i)) / 20 for i in (1, 2, 3, 4)]
    rows = table(spark, at, "annotations").filter("ann_key is not null").select("ann_key", "annotation").distinct()
    rows = rows.filter(manifest.rejection(F.lit("x"), F.col("annotation.bbox")).isNull())
    low = lambda v: F.greatest(F.lit(0), F.floor(v) - 2)
    high = lambda v, most: F.least(F.lit(most), F.ceil(v) + 2)
    samples = rows.select("ann_key", F.col("ann_key").alias("sample"), F.lit("").alias("label"), low(box[0]).alias("left"), low(box[1]).alias("top"), high(box[0] + box[2], 120).alias("right"), high(box[1] + box[3], 160).alias("bottom"), F.lit("clean").alias("variant"), F.lit("k").alias("seed"))
    pages = rows.select("ann_key", F.unhex(F.repeat(F.lpad(F.hex(F.col("ann_key") % 200), 2, "0"), F.lit(120 * 160))).alias("data"), F.lit(160).alias("height"), F.lit(120).alias("width"), F.lit(1).alias("nChannels"))
    made = images.cropped(pages, samples, "ann_key", "sample", png=False)
    one = F.conv(F.substring(F.hex("pixels"), 1, 2), 16, 10).cast("long")
    alike = F.hex("pixels") == F.repeat(F.substring(F.hex("pixels"), 1, 2), F.length("pixels"))
    return made.select("ann_key", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), F.when(alike, one).alias("grey"))
