"""Registered queries of the pipeline operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import scratch_path
from ..sources.io import scan_table
from . import (
    alignment,
    decontaminate,
    html_extract,
    license_scan,
    merkle,
    ngram_join,
    packing,
    quality,
    quality_model,
    substring_dedup,
    suffix_dedup,
    url_filter,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return scan_table(spark, f"{folder.rstrip('/')}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark, folder):
    found = ngram_join.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "n_links")


@query
def op2_url_filter(spark, folder):
    model = url_filter.train(url_filter.labelled_urls(spark))
    found = url_filter.judged(table(spark, folder, "pages"), model)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query
def op3_quality_rules(spark, folder):
    found = quality.judged(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op4_warc(spark, folder):
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.page_records(table(spark, folder, "pages")), path)
    found = warc.read_archives(spark, path)
    # a response is measured on what was read; a revisit tells what it refers to
    own = F.col("record_type") == "response"
    return found.select(
        warc.page_id_of(F.col("record_id")).alias("page_id"),
        F.when(own, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        warc.page_id_of(F.col("refers_to")).alias("refers_to"),
    )


@query
def op5_license_scan(spark, folder):
    found = license_scan.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "license", "n_matched", "coverage", "first_word", "last_word", "start", "end")


@query
def op6_best_fit_packing(spark, folder):
    return packing.packed(table(spark, folder, "documents")).drop("text_key")


@query
def op7_html_extraction(spark, folder):
    return html_extract.main_text(table(spark, folder, "pages"))


@query
def op8_substring_dedup(spark, folder):
    found = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op9_suffix_array_dedup(spark, folder):
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"), keep_first=False)
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op10_benchmark_decontamination(spark, folder):
    found = decontaminate.contained_items(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.select("doc_id", "item_id", "n_item", "n_shared")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query
def op11_merkle_manifest(spark, folder):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(tampered, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    return merkle.manifest(table(spark, folder, "documents"), changes={"text": text})


@query
def op12_quality_classifier(spark, folder):
    return quality_model.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op13_cross_tokenizer_alignment(spark, folder):
    return alignment.aligned(table(spark, folder, "documents"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_SHINGLES = f"""
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM docs, unnest(range(1, greatest(2, len(w) - 3))) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1)
"""

ORACLE["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE {_SHINGLES},
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE common >= 0.8 * (x.n + y.n - common)
),
reach AS (
  SELECT a AS node, b AS other FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
),
least AS (SELECT node, min(other) AS m FROM reach GROUP BY 1),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT d.doc_id, coalesce(least(m, d.doc_id), d.doc_id) AS class_id, coalesce(n, 0) AS n_links
FROM documents d LEFT JOIN least ON node = d.doc_id LEFT JOIN counts ON a = d.doc_id
"""

ORACLE["op3_quality_rules"] = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents
),
triples AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s
  FROM docs, unnest(range(1, len(w) - 1)) AS t(i)
),
often AS (SELECT doc_id, s FROM triples GROUP BY 1, 2 HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM triples JOIN often USING (doc_id, s), (VALUES (0), (1), (2)) AS v(k) GROUP BY 1
),
lines AS (
  SELECT doc_id, source, t, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM docs, unnest(string_split(t, chr(10))) AS u(line)
),
worded AS (
  SELECT *, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM lines WHERE len(lw) > 0
),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY 1),
totals AS (SELECT source, count(DISTINCT t) AS documents FROM docs GROUP BY 1),
above AS (
  SELECT w.source, norm FROM worded w JOIN totals x ON w.source IS NOT DISTINCT FROM x.source
  GROUP BY w.source, norm, documents
  HAVING count(DISTINCT t) > 5 AND (count(DISTINCT t) > 0.1 * documents OR count(DISTINCT t) > 10000)
),
lost AS (
  SELECT doc_id, sum(len(lw)) AS n FROM worded w
  JOIN above a ON a.norm = w.norm AND a.source IS NOT DISTINCT FROM w.source GROUP BY 1
),
base AS (
  SELECT doc_id,
    len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols
  FROM docs
)
SELECT b.doc_id, n_words, word_chars, n_symbols,
  coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
  coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(repeats.n, 0) > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(repeats.n, 0) > 50 * n_words)
    AND n_words - coalesce(lost.n, 0) >= 0.5 * n_words AS kept
FROM base b LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

ORACLE["op4_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM q
"""

ORACLE["op8_substring_dedup"] = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
  FROM docs, unnest(range(1, len(w) - 33)) AS t(i)
),
often AS (SELECT s FROM windows GROUP BY 1 HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM windows SEMI JOIN often USING (s)),
words AS (SELECT doc_id, i, w[i] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(i)),
marked AS (
  SELECT doc_id, i, word,
    coalesce(max(place) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) > i - 35, false) AS gone
  FROM words LEFT JOIN (SELECT doc_id, i, i AS place FROM starts) s USING (doc_id, i)
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words,
  coalesce(count(*) FILTER (gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM docs d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id, len(d.w)
"""

ORACLE["op9_suffix_array_dedup"] = """
WITH docs AS (
  SELECT doc_id, encode(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents
),
windows AS (
  SELECT doc_id, i, hash(h[i + 1:i + 400]) AS a, hash(h[i + 1:i + 399]) AS b
  FROM docs, unnest(range(0, n - 399)) AS t(i)
),
often AS (SELECT a, b FROM windows GROUP BY 1, 2 HAVING count(*) > 1),
starts AS (SELECT doc_id, i, i AS place FROM windows SEMI JOIN often USING (a, b)),
bytes AS (SELECT doc_id, i, hex(h[i + 1:i + 1]) AS x FROM docs, unnest(range(0, n)) AS t(i)),
marked AS (
  SELECT doc_id, i, x,
    coalesce(max(place) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) > i - 400, false) AS gone
  FROM bytes LEFT JOIN starts USING (doc_id, i)
),
runs AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM marked)
SELECT d.doc_id, d.n::BIGINT AS n_bytes,
  coalesce(count(*) FILTER (gone), 0)::BIGINT AS n_removed,
  coalesce(count(*) FILTER (opens), 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
FROM docs d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id, d.n
"""

ORACLE["op10_benchmark_decontamination"] = f"""
WITH {_SHINGLES},
items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
asked AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM items, unnest(range(1, greatest(2, len(w) - 3))) AS t(i) WHERE len(w) > 0
),
item_sizes AS (SELECT item_id, count(*) AS n FROM asked GROUP BY 1)
SELECT doc_id, item_id, any_value(x.n)::INTEGER AS n_item, count(*)::INTEGER AS n_shared
FROM sets JOIN asked USING (s) JOIN item_sizes x USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(x.n)
"""

# bitwise CRC-32: every byte is followed by eight shift steps (-1)
_CRC = """
xor(list_reduce(
  flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END,
  4294967295::BIGINT), 4294967295)
"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _climb(name: str, nodes: str) -> str:
    """Tree ``name`` (grp, lvl, pos, node, n) over the lowest level ``nodes`` (grp, pos, node)."""
    return f"""
{name} AS (
  SELECT grp, 0 AS lvl, pos, node, count(*) OVER (PARTITION BY grp) AS n FROM ({nodes})
  UNION ALL
  SELECT grp, lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), count(*) OVER (PARTITION BY grp)
  FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 16
)"""


def _flanks(tree: str, start: str, offset: str) -> str:
    """Digests before and after a row's node on every level of a tree that has several nodes."""
    return f"""
  SELECT r.row, {offset} + t.lvl AS step,
    coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < r.{start} // (16 ** t.lvl)::BIGINT), '') AS before,
    coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > r.{start} // (16 ** t.lvl)::BIGINT), '') AS after
  FROM rows r JOIN {tree} t ON t.n > 1 AND t.grp = r.{'grp' if tree == 'trees' else 'one'}
    AND t.pos // 16 = r.{start} // (16 ** (t.lvl + 1))::BIGINT
  GROUP BY r.row, t.lvl"""


ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS grp, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {_leaf("text")} END AS present
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
),
{_climb("trees", "SELECT grp, pos, leaf AS node FROM placed")},
subroots AS (
  SELECT grp, node AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS place FROM trees WHERE n = 1
),
{_climb("tops", "SELECT 0 AS grp, place AS pos, subroot AS node FROM subroots")},
rows AS (SELECT p.*, subroot, place, 0 AS one FROM placed p JOIN subroots USING (grp)),
flanks AS ({_flanks("trees", "pos", "0")}
  UNION ALL {_flanks("tops", "place", "100")}
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY step) AS turn FROM flanks),
folded AS (
  SELECT row, 1 AS turn, present AS node FROM rows
  UNION ALL
  SELECT f.row, f.turn + 1, sha256(before || node || after) FROM folded f JOIN numbered m ON m.row = f.row AND m.turn = f.turn
),
last AS (SELECT row, arg_max(node, turn) AS folded_root FROM folded GROUP BY row),
proofs AS (SELECT row, sha256(string_agg(before || after, '' ORDER BY turn)) AS proof FROM numbered GROUP BY row),
top AS (SELECT node AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM rows JOIN last USING (row) LEFT JOIN proofs USING (row), top
"""
