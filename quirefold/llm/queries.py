"""Queries pN_ of this subpackage, each over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bitext, leaks, lookalike, mixture, repeats, scans, segment, stuffing, terms
from quirefold.sources.tables import table

#: Folder of public tokenizers and the one that measures sizes.
TOKENIZERS = os.environ.get("QUIREFOLD_TOKENIZERS", "/opt/tokenizers")
SIZE_TOKENIZER = "byte_bpe_50k.json"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    occurrences, _ = repeats.repeated_blocks(table(spark, d, "elements"), table(spark, d, "docs"))
    return occurrences.select("doc_id", "page", "idx", "line_no").distinct()


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    return repeats.block_counts(repeats.repeated_blocks(table(spark, d, "elements"), table(spark, d, "docs"))[1])


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    elements = table(spark, d, "elements").select("doc_id", "page", "idx", "text").dropDuplicates(["doc_id", "page", "idx"])
    occurrences, _ = repeats.repeated_blocks(table(spark, d, "elements"), table(spark, d, "docs"))
    return repeats.without_repeats(elements, occurrences)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return bitext.aligned_sentences(table(spark, d, "elements"), table(spark, d, "doc_pairs")).drop("sim")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return segment.sentence_ends(table(spark, d, "elements"))


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    cut = segment.to_cut(table(spark, d, "elements"))
    filled = segment.with_sentences(cut.withColumns({"kind": F.lit("text"), "sentences": F.lit(None).cast("array<string>")}))
    return filled.select("doc_id", "page", "idx", F.posexplode("sentences").alias("sent", "sentence"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "elements"))


def p4_consistent(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_text(table(spark, d, "elements")).filter("changed").select("doc_id", "page", "idx", "canonical")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_words(table(spark, d, "elements"), table(spark, d, "dictionary"))


def p5_bigrams(spark: SparkSession, d: str) -> DataFrame:
    counts = terms.term_counts(table(spark, d, "elements"), depth=2, emit=(2,))
    return counts.filter("n = 2").select("term", "occurrences", "records")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(table(spark, d, "elements"), depth=1).filter("n = 1").select("term", "occurrences", "records")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(table(spark, d, "elements"), table(spark, d, "pages_geo"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_paragraphs(table(spark, d, "elements"), table(spark, d, "pages_geo"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.filter(F.col("run") >= leaks.RUN).select("doc_id", "item_id")


def p7_scored(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_scores(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), f"{TOKENIZERS}/{SIZE_TOKENIZER}")[1]


def p8_rows(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), f"{TOKENIZERS}/{SIZE_TOKENIZER}")[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents")).select("doc_id")


def p9_shapes(spark: SparkSession, d: str) -> DataFrame:
    by = stuffing.document_shapes(table(spark, d, "documents"))
    return by.groupBy("shape").agg(F.sum("chars").alias("chars"), F.sum("units").alias("units"), F.count("*").alias("docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_blocks, p1_cleaned, p2_found, p3_found, p3_sentences, p4_found, p4_consistent, p5_found, p5_terms, p5_bigrams, p6_found, p6_repaired, p7_found, p7_scored, p8_shares, p8_rows, p9_found, p9_shapes)}


# An independent account in SQL of the queries that SQL expresses in reasonable time.
P1 = r"""
WITH s AS (SELECT source, count(DISTINCT doc_id) AS n FROM docs WHERE source IS NOT NULL GROUP BY 1),
cut AS (SELECT DISTINCT doc_id, page, idx, string_split(text, chr(10)) AS parts FROM elements WHERE text IS NOT NULL),
l AS (SELECT doc_id, page, idx, i - 1 AS line_no, regexp_replace(lower(parts[i]), '[^\p{L}]', '', 'g') AS k
      FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut)),
k AS (SELECT l.*, d.source FROM l JOIN (SELECT DISTINCT doc_id, source FROM docs WHERE source IS NOT NULL) d USING (doc_id) WHERE length(k) >= 30),
f AS (SELECT k.source, k FROM k JOIN s ON s.source = k.source GROUP BY 1, 2
      HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.35 * any_value(s.n))
"""
#: Blocks of up to four lines; longer ones count as four.
BLOCKS = r"""
WITH s AS (SELECT source, count(DISTINCT doc_id) AS n FROM docs WHERE source IS NOT NULL GROUP BY 1),
e AS (SELECT DISTINCT ON (doc_id, page, idx) doc_id, page, idx, string_split(text, chr(10)) AS parts FROM elements WHERE text IS NOT NULL),
l AS (SELECT doc_id, page, idx, i, regexp_replace(lower(parts[i]), '[^\p{L}]', '', 'g') AS k1 FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM e)),
q AS (SELECT doc_id, row_number() OVER w AS pos, k1, k1 || '|' || lead(k1, 1) OVER w AS k2, k1 || '|' || lead(k1, 1) OVER w || '|' || lead(k1, 2) OVER w AS k3,
  k1 || '|' || lead(k1, 1) OVER w || '|' || lead(k1, 2) OVER w || '|' || lead(k1, 3) OVER w AS k4 FROM l WHERE k1 <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY page, idx, i)),
g AS (SELECT q.*, d.source FROM q JOIN (SELECT DISTINCT doc_id, source FROM docs WHERE source IS NOT NULL) d USING (doc_id)),
f AS (SELECT source, k FROM (SELECT doc_id, source, unnest([k1, k2, k3, k4]) AS k FROM g) JOIN s USING (source) WHERE k IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.35 * any_value(n)),
b AS (SELECT source, doc_id, CASE WHEN (source, k4) IN (SELECT (source, k) FROM f) THEN 4 WHEN (source, k3) IN (SELECT (source, k) FROM f) THEN 3 WHEN (source, k2) IN (SELECT (source, k) FROM f) THEN 2 WHEN (source, k1) IN (SELECT (source, k) FROM f) THEN 1 END AS depth, k1, k2, k3, k4 FROM g)
SELECT source, depth, count(DISTINCT CASE depth WHEN 4 THEN k4 WHEN 3 THEN k3 WHEN 2 THEN k2 ELSE k1 END) AS blocks, count(*) AS places, count(DISTINCT doc_id) AS docs FROM b WHERE depth IS NOT NULL GROUP BY 1, 2
"""
WORDS = r"""
WITH e AS (SELECT DISTINCT ON (doc_id, page, idx) doc_id, page, idx, sentences FROM elements WHERE len(sentences) > 0),
s AS (SELECT row_number() OVER () AS sid, doc_id, page, idx, s FROM (SELECT doc_id, page, idx, unnest(sentences) AS s FROM e)),
a AS (SELECT sid, doc_id, page, idx, regexp_extract_all(lower(s), '[a-z](?:[a-z''’-]*[a-z])?') AS ws FROM s WHERE s IS NOT NULL)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1 + "SELECT DISTINCT doc_id, page, idx, CAST(line_no AS INTEGER) AS line_no FROM k JOIN f USING (source, k)",
        "p1_blocks": BLOCKS,
        "p1_cleaned": P1
        + """, g AS (SELECT doc_id, page, idx, list(DISTINCT line_no) AS l FROM k JOIN f USING (source, k) GROUP BY 1, 2, 3), e AS (SELECT DISTINCT ON (doc_id, page, idx) doc_id, page, idx, text FROM elements)
SELECT e.doc_id, e.page, e.idx, CASE WHEN l IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(l, i - 1)), chr(10)) END AS text
FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.page = e.page AND g.idx = e.idx""",
        "p5_found": WORDS
        + """, w AS (SELECT unnest(ws) AS word, doc_id, page, idx FROM a), k AS (SELECT word, count(DISTINCT (doc_id, page, idx)) AS n FROM w GROUP BY 1),
d AS (SELECT DISTINCT lower(trim(word, ' ' || chr(9) || chr(10) || chr(13))) AS word FROM dictionary WHERE trim(word, ' ' || chr(9) || chr(10) || chr(13)) <> '')
SELECT word, 'rare' AS mark FROM k WHERE n <= 2 UNION ALL SELECT word, 'common' FROM k WHERE n > 0.1 * (SELECT count(*) FROM e)
UNION ALL SELECT word, 'unseen' FROM d WHERE word NOT IN (SELECT word FROM k)""",
        "p5_terms": WORDS
        + """, w AS (SELECT unnest(ws) AS term, doc_id, page, idx FROM a) SELECT term, count(*) AS occurrences, count(DISTINCT (doc_id, page, idx)) AS records FROM w GROUP BY 1""",
        "p5_bigrams": WORDS
        + """, b AS (SELECT doc_id, page, idx, ws[i] || ' ' || ws[i + 1] AS term FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM a))
SELECT term, count(*) AS occurrences, count(DISTINCT (doc_id, page, idx)) AS records FROM b GROUP BY 1""",
    }
