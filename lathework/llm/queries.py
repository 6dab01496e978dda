"""The queries of this folder's operators, with production parameters, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints as fp
from ._bpe import vocabulary
from ._io import let, words
from .bpe_codec import encode
from .filter_audit import filter_audit
from .license_scan import inherit, scan
from .packing import pack
from .periodic_runs import periodic_runs
from .quality_classifier import fit, score
from .quality_rules import quality_rules
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .suffix_array_dedup import suffix_array_dedup
from .token_counts import token_counts
from .warc import round_trip


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "n_spans"
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return score(docs, fit(docs, _read(spark, sf_dir, "labels")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path, so source and language stand for directories."""
    docs = _read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return inherit(scan(docs.withColumn("path", path)))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, _read(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sketch")
    return fp.fingerprints(_read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fp.packed(s).alias("fingerprint"),
        fp.packed(F.col("edited_sketch")).alias("edited_fingerprint"),
        fp.resemblance(s, F.col("edited_sketch")).alias("near_edited"),
        fp.resemblance(s, F.col("next_sketch")).alias("near_next"),
        fp.containment(s, F.col("edited_sketch")).alias("contained_in_edited"),
        fp.distinct_count(s).alias("n_shingles"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def repeating(doc_id: Column, text: Column) -> Column:
    """The text, with its words from some place on made periodic where the id's checksum says so."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = F.floor((n - a) / (F.lit(3) + g % 8)) + 1
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        taken = F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(taken, " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words(text), periodic)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", repeating(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])  # noqa: E731
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_quality_classifier,
        op3_license_scan,
        op4_warc,
        op5_simhash,
        op6_fingerprints,
        op7_packing,
        op8_quality_rules,
        op9_suffix_array_dedup,
        op10_bpe_codec,
        op11_periodic_runs,
        op12_token_counts,
        op13_filter_audit,
    )
}
#: Lengths of windows, as powers of two, among which the SQL of the runs looks for periods: up to 2^15 words.
_LEVELS = 16


def _runs_sql() -> str:
    """Windows of 2^k words repeat next at a distance of the period in a run of a period from 2^(k-1) + 1 to 2^k; windows are ranked by pairs of the level before."""
    levels = []
    for k in range(_LEVELS):
        if k:
            pairs = f"SELECT doc_id, i, id AS x, lead(id, {1 << (k - 1)}) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM l{k - 1}"
            levels.append(f"l{k} AS MATERIALIZED (SELECT doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY x, y) AS id FROM ({pairs}) WHERE y IS NOT NULL)")
        near = f"SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id, id ORDER BY i) - i AS q FROM l{k}"
        island = f"SELECT doc_id, i, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM ({near}) WHERE q > {(1 << k) / 2} AND q <= {1 << k}"
        levels.append(f"r{k} AS (SELECT doc_id, min(i) AS start, max(i) - min(i) + q + {1 << k} AS length, q FROM ({island}) GROUP BY doc_id, q, island HAVING max(i) - min(i) + q + {1 << k} >= greatest(6, 4 * q))")
    return ", ".join(levels) + ", runs AS (" + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(_LEVELS)) + ")"


SQL: dict[str, str] = {
    "op11_periodic_runs": rf"""
        WITH t AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS crc FROM range(256) AS r(i)
        ), d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, t
        ), g AS (
            SELECT *, len(w)::BIGINT AS n, h // 10 AS g, h % 10 = 0 AS made FROM d
        ), p AS (
            SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM g
        ), u AS (
            SELECT doc_id, unnest(range(n)) AS i, w, made, a, p FROM p
        ), words AS MATERIALIZED (
            SELECT doc_id, i, w[CASE WHEN made AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM u
        ), l0 AS MATERIALIZED (
            SELECT doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY word) AS id FROM words
        ), {_runs_sql()}, found AS (
            SELECT doc_id, count(*) AS n_runs, first({{'start': start, 'length': length, 'period': q}} ORDER BY length / q DESC, start, q) AS best,
                   string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words
            WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.doc_id = words.doc_id AND words.i >= start + q AND words.i < start + length) GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM d LEFT JOIN found ON found.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
    """,
    "op1_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), p AS (
            SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
        ), g AS (
            SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS win FROM p
        ), d AS (
            SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM g
        ), c AS (
            SELECT *, coalesce(i - max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 20, false) AS gone FROM d
        ), e AS (
            SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c
        ), k AS (
            SELECT doc_id, count(*) FILTER (gone) AS n, count(*) FILTER (opens) AS spans, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
            FROM e GROUP BY doc_id
        )
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(spans, 0) AS n_spans
        FROM w LEFT JOIN k ON k.doc_id = w.doc_id
    """,
    "op4_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS digest FROM pages
        ), m AS (
            SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS last FROM p
        )
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> last THEN last END::BIGINT AS refers_to
        FROM m
    """,
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
        ), w AS (
            SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d
        ), f AS (
            SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
                   100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, doc_id > first AS e FROM w
        ), m AS (
            SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
                   count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
            GROUP BY ALL
        ), l AS (
            SELECT chr(65 + i::INT) AS name, (1 << i)::INT AS bit FROM range(5) AS r(i)
        ), o AS (
            SELECT l1.name || l2.name || l3.name || l4.name || l5.name AS filter_order,
                   unnest([{'step': 1, 'name': l1.name, 'bit': l1.bit, 'before': 0}, {'step': 2, 'name': l2.name, 'bit': l2.bit, 'before': l1.bit},
                           {'step': 3, 'name': l3.name, 'bit': l3.bit, 'before': l1.bit + l2.bit},
                           {'step': 4, 'name': l4.name, 'bit': l4.bit, 'before': l1.bit + l2.bit + l3.bit},
                           {'step': 5, 'name': l5.name, 'bit': l5.bit, 'before': 31 - l5.bit}]) AS s
            FROM l AS l1, l AS l2, l AS l3, l AS l4, l AS l5 WHERE l1.bit + l2.bit + l3.bit + l4.bit + l5.bit = 31
                AND len(list_distinct([l1.name, l2.name, l3.name, l4.name, l5.name])) = 5
        ), r AS (
            SELECT part, filter_order, s.name AS name, s.step::INT AS step,
                   coalesce(sum(n) FILTER (mask & (s.before | s.bit) = 0), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (mask & s.bit > 0 AND mask & s.before = 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (mask & s.bit > 0 AND mask & s.before > 0), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (mask = s.bit), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (mask & s.bit > 0 AND mask & s.before = 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (mask & s.bit > 0 AND mask & s.before = 0), 0)::BIGINT AS toxic_lost
            FROM m, o GROUP BY ALL
        )
        SELECT * EXCLUDE (name), (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM r
    """,
}
