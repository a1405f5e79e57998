"""Cleaning, sections, chunks, tags and merged extraction results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import text
from lexigraph.operators import extract, joins
from lexigraph.plans.registry import query

WORDS = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def _sql_rules(col: str, rules) -> str:
    for pattern, value in rules:
        col = f"regexp_replace({col}, E'{_esc(pattern)}', E'{_esc(value)}', 'g')"
    return col


def _esc(s: str) -> str:
    return s.replace("\\", "\\\\").replace("\n", "\\n").replace("'", "''")


@query("s5_clean_html", f"SELECT page_id, {_sql_rules(_sql_rules('html', text.HTML_RULES), text.SPACE_RULES)} AS text "
       "FROM pages")
def _(d):
    pages = d.raw("pages").select("page_id", F.col("html").alias("text"))
    return extract.clean_documents(pages, "html")


@query("x1_estimate_tokens", f"SELECT doc_id, ceil(len({WORDS.format(c='text')}) * 1.3)::BIGINT AS tokens FROM fx_docs")
def _(d):
    return d.docs().select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


_SECTIONS = """
lines AS (SELECT doc_id, source_type, length(text) AS total, unnest(string_split(text, E'\\n')) AS line,
  generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM fx_job_docs),
placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_offset,
  lower(regexp_replace(trim(line), '^#+\\s*|\\s*:$', '', 'g')) AS k FROM lines),
heads AS (SELECT *, CASE k WHEN 'requirements' THEN 'requirements' WHEN 'nice to have' THEN 'nice_to_have'
  WHEN 'about us' THEN 'company' WHEN 'skills' THEN 'skills' WHEN 'experience' THEN 'experience'
  WHEN 'education' THEN 'education' END AS section_type, CASE k WHEN 'requirements' THEN 1.0 WHEN 'nice to have'
  THEN 0.75 WHEN 'about us' THEN 0.5 WHEN 'skills' THEN 1.0 WHEN 'experience' THEN 0.9 WHEN 'education' THEN 0.8
  END::DOUBLE AS weight FROM placed),
sections AS (SELECT doc_id, CASE source_type WHEN 'course' THEN 'generic' ELSE source_type END AS doc_type,
  line AS section_name, section_type, weight, start_offset,
  coalesce(lead(start_offset) OVER (PARTITION BY doc_id ORDER BY i), total)::INT AS end_offset
  FROM heads WHERE section_type IS NOT NULL)"""


@query("x2_detect_sections", f"WITH {_SECTIONS} SELECT * FROM sections")
def _(d):
    return extract.explode_sections(extract.detect_sections(d.job_docs()))


@query("x2_doc_types", "SELECT doc_id, CASE source_type WHEN 'course' THEN 'generic' ELSE source_type END AS doc_type "
       "FROM fx_job_docs")
def _(d):
    return extract.detect_sections(d.job_docs()).select("doc_id", "doc_type")


@query("x3_section_weights", f"""WITH {_SECTIONS}
SELECT doc_type, section_type, weight, count(*) AS sections FROM sections GROUP BY 1, 2, 3""")
def _(d):
    return (extract.explode_sections(extract.detect_sections(d.job_docs()))
            .groupBy("doc_type", "section_type", "weight").agg(F.count(F.lit(1)).alias("sections")))


# Every section of the written documents is far below the target, so each is one chunk.
@query("x4_chunk_sections", f"""WITH {_SECTIONS},
s AS (SELECT doc_id, section_type, weight, start_offset, end_offset FROM sections
  UNION ALL SELECT doc_id, NULL, 1.0, 0, length(text) FROM fx_job_docs WHERE source_type = 'course')
SELECT s.doc_id, (row_number() OVER (PARTITION BY s.doc_id ORDER BY start_offset) - 1)::INT AS chunk_index,
  section_type AS section, weight AS section_weight, start_offset, end_offset,
  substr(text, start_offset + 1, end_offset - start_offset) AS text
FROM s JOIN fx_job_docs USING (doc_id)""")
def _(d):
    return extract.chunk_sections(extract.detect_sections(d.job_docs())).select(
        "doc_id", "chunk_index", "section", "section_weight", "start_offset", "end_offset", "text")


@query("x4_chunk_sections_packed", """
WITH RECURSIVE_PIECES AS (
  SELECT doc_id, text, unnest(string_split(text, E'\\n')) AS line,
    generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM fx_docs),
pieces AS (SELECT doc_id, i, CASE WHEN i = 1 THEN line ELSE E'\\n' || line END AS piece,
  len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) * 1.3 AS tok FROM RECURSIVE_PIECES),
packed(doc_id, i, chunk, tok) AS (
  SELECT doc_id, 1::BIGINT, 0, tok::DOUBLE FROM pieces WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, k.chunk + (k.tok > 0 AND k.tok + p.tok > 150)::INT,
    CASE WHEN k.tok > 0 AND k.tok + p.tok > 150 THEN p.tok::DOUBLE ELSE k.tok + p.tok::DOUBLE END
  FROM packed k JOIN pieces p ON p.doc_id = k.doc_id AND p.i = k.i + 1)
SELECT p.doc_id, chunk AS chunk_index, string_agg(piece, '' ORDER BY p.i) AS text
FROM pieces p JOIN packed k ON p.doc_id = k.doc_id AND p.i = k.i GROUP BY 1, 2""")
def _(d):
    return extract.chunk_paragraphs(d.docs(), 150, 1_000_000, boundary=r"(?=\n)").select(
        "doc_id", "chunk_index", "text")


_SLIDE = """
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+\\s*') AS ws FROM fx_docs),
f AS (SELECT doc_id, ws, unnest(generate_series(0, greatest(len(ws) - 15 - 1, 0), 100)) AS p0 FROM w WHERE len(ws) > 0),
e AS (SELECT *, least(p0 + 115, len(ws)) AS full_end FROM f),
"""


@query("x5_chunk_sliding", _SLIDE + """
c AS (SELECT doc_id, p0, length(array_to_string(ws[1:p0], '')) AS start_offset,
  array_to_string(ws[p0 + 1:full_end], '') AS text FROM e)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p0) - 1)::INT AS chunk_index,
  start_offset::INT AS start_offset, (start_offset + length(text))::INT AS end_offset, text FROM c""")
def _(d):
    return extract.chunk_sliding(d.docs(), 150, 20, snap=False).select(
        "doc_id", "chunk_index", "start_offset", "end_offset", "text")


@query("x5_chunk_sliding_sentences", _SLIDE + """
s AS (SELECT *, CASE WHEN full_end < len(ws) AND full_end >= p0 + 100 THEN coalesce(list_max(list_filter(
  generate_series(p0 + 100, full_end), lambda i: regexp_matches(ws[i], '[.!?]\\s*$'))), full_end) ELSE full_end END
  AS stop FROM e)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p0) - 1)::INT AS chunk_index,
  array_to_string(ws[p0 + 1:stop], '') AS text FROM s""")
def _(d):
    return extract.chunk_sliding(d.docs(), 150, 20).select("doc_id", "chunk_index", "text")


@query("x6_chunk_paragraphs", """
SELECT doc_id, 0 AS chunk_index, 0 AS start_offset, length(text)::INT AS end_offset,
  ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3)::BIGINT AS token_estimate
FROM fx_job_docs""")
def _(d):
    return extract.chunk_paragraphs(d.job_docs()).select(
        "doc_id", "chunk_index", "start_offset", "end_offset", "token_estimate")


@query("x7_chunk_semantic", """
WITH v AS (SELECT conv_id AS doc_id, turn AS position, embedding::DOUBLE[] AS e FROM conversations
  JOIN embeddings ON vec_id = (conv_id * 7 + turn) % (SELECT n FROM fx_vec_n)),
b AS (SELECT *, CASE WHEN round(list_cosine_similarity(e, lag(e) OVER (PARTITION BY doc_id ORDER BY position)), 6) < 0
  THEN 1 ELSE 0 END AS brk FROM v)
SELECT doc_id, position, (sum(brk) OVER (PARTITION BY doc_id ORDER BY position))::BIGINT AS chunk_index FROM b""")
def _(d):
    vec = d.raw("embeddings")
    size = vec.agg(F.count(F.lit(1)).alias("n"))
    turns = d.raw("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"))
    keyed = turns.withColumn("vec_id", (F.col("doc_id") * 7 + F.col("position")) % size.scalar())
    return extract.chunk_semantic(keyed.join(vec, "vec_id"), 0.0).select("doc_id", "position", "chunk_index")


def _doc_chunks(d) -> DataFrame:
    return d.docs().withColumns({"chunk_index": F.lit(0), "section_weight": F.lit(1.0),
                                 "section": F.lit(None).cast("string"),
                                 "token_estimate": text.estimate_tokens(F.col("text"))})


def _forms(d) -> DataFrame:
    return d.dictionary().withColumnRenamed("surface_form", "form")


# One tokenizer for text and forms; a match inside a longer one, and one over a sentence mark, does not count.
_TOKENS = r"regexp_extract_all(lower({c}), '\.?[\p{{L}}\p{{N}}]+(?:\.[\p{{L}}\p{{N}}]+)*[+#]*|[.!?]+')"


def _tags_sql(docs: str, forms: str, most: int) -> str:
    grams = " UNION ALL ".join(
        f"SELECT doc_id, position, {n} AS words, array_to_string(ws[position:position + {n - 1}], ' ') AS key FROM toks "
        f"WHERE position + {n - 1} <= len(ws)" for n in range(1, most + 1))
    return f"""
known AS (SELECT DISTINCT skill_id, form, len(t) AS words, array_to_string(t, ' ') AS key FROM (SELECT skill_id, form,
  list_filter({_TOKENS.format(c="form")}, lambda t: NOT regexp_full_match(t, '[.!?]+')) AS t FROM {forms})),
toks AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS position
  FROM (SELECT doc_id, {_TOKENS.format(c="text")} AS ws FROM {docs})),
grams AS ({grams}),
hits AS (SELECT g.* FROM grams g JOIN (SELECT DISTINCT key, words FROM known) USING (key, words)
  WHERE NOT regexp_matches(key, '(^| )[.!?]+( |$)')),
kept AS (SELECT *, max(position + words) OVER (PARTITION BY doc_id ORDER BY position, words DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
tags AS (SELECT doc_id, skill_id, form, position, words FROM kept JOIN known USING (key, words)
  WHERE coalesce(reach, 0) < position + words)"""


_TAGS = _tags_sql("fx_docs", "(SELECT skill_id, surface_form AS form FROM fx_dictionary)", 5)


@query("j8_tag_exact", f"WITH {_TAGS} SELECT doc_id, skill_id, form, position::INT AS position FROM tags")
def _(d):
    return extract.tag_exact(_doc_chunks(d), _forms(d)).select("doc_id", "skill_id", "form", "position")


def _phrase_forms(d) -> DataFrame:
    """Part names of two words, and each of their words on its own."""
    name = F.lower("p_name")
    return d.raw("part").select(F.explode(F.array(name, F.split_part(name, F.lit(" "), F.lit(2)))).alias("form")) \
        .distinct().select(F.concat(F.lit("W:"), "form").alias("skill_id"), "form")


_PHRASES = _tags_sql("fx_job_docs", """(SELECT DISTINCT concat('W:', f) AS skill_id, f AS form FROM (
  SELECT unnest([lower(p_name), split_part(lower(p_name), ' ', 2)]) AS f FROM part))""", 2)


@query("j8_tag_phrases", f"WITH {_PHRASES} SELECT doc_id, form, position::INT AS position, words::INT AS words FROM tags")
def _(d):
    chunks = d.job_docs().withColumn("chunk_index", F.lit(0))
    return extract.tag_exact(chunks, _phrase_forms(d)).select("doc_id", "form", "position", "words")


@query("j10_assign_sections", f"""WITH {_SECTIONS},
w AS (SELECT doc_id, regexp_extract_all(text, '\\S+\\s*') AS ws FROM fx_job_docs),
c AS (SELECT doc_id, p0, length(array_to_string(ws[1:p0], '')) AS start_offset FROM (
  SELECT doc_id, ws, unnest(generate_series(0, greatest(len(ws) - 2, 0), 7)) AS p0 FROM w))
SELECT c.doc_id, c.start_offset::INT AS start_offset, section_type, coalesce(weight, 1.0) AS section_weight
FROM c LEFT JOIN sections s ON s.doc_id = c.doc_id AND c.start_offset >= s.start_offset
 AND c.start_offset < s.end_offset""")
def _(d):
    docs = d.job_docs()
    chunks = extract.chunk_sliding(docs, 11, 2, snap=False).select("doc_id", "start_offset")
    return joins.assign_sections(chunks, extract.explode_sections(extract.detect_sections(docs)))


@query("x8_extract", f"""WITH {_TAGS}
SELECT doc_id, skill_id, 1.0::DOUBLE AS confidence, string_agg(DISTINCT form, ',' ORDER BY form) AS evidence, 'exact' AS origin
FROM tags GROUP BY 1, 2
UNION ALL SELECT doc_id, skill_id, confidence, evidence, 'model' FROM (
  SELECT m.doc_id, skill_id, max(confidence) AS confidence, min(evidence) AS evidence FROM fx_mentions m
  JOIN fx_docs USING (doc_id) GROUP BY 1, 2)""")
def _(d):
    chunks = _doc_chunks(d)
    answers = d.mentions().groupBy("doc_id", "skill_id").agg(
        F.max("confidence").alias("confidence"), F.array(F.min(F.col("evidence")[0])).alias("evidence"))
    answers = answers.withColumns({"chunk_index": F.lit(0), "proficiency_hint": F.lit("unknown"),
                                   "context_type": F.lit("explicit"), "section_weight": F.lit(1.0)})
    answers = answers.join(chunks.select("doc_id"), "doc_id", "left_semi")
    out = extract.extract(extract.tag_exact(chunks, _forms(d), carry=("section_weight",)), responses=answers)
    return out.select("doc_id", "skill_id", "confidence", F.array_join("evidence", ",").alias("evidence"), "origin")


@query("x9_apply_weighting", """
SELECT doc_id, chunk_index, skill_id, section, round(confidence * section_weight, 6) AS confidence FROM fx_mentions""")
def _(d):
    return extract.apply_weighting(d.mentions()).select(
        "doc_id", "chunk_index", "skill_id", "section", F.round("confidence", 6).alias("confidence"))


@query("x10_merge_results", """
SELECT doc_id, skill_id, round(max(confidence * section_weight), 6) AS confidence,
  string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence,
  arg_max(proficiency_hint, chunk_index * 2 + (proficiency_hint = 'expert')::INT) AS proficiency_hint
FROM fx_mentions GROUP BY 1, 2""")
def _(d):
    return extract.merge_results(extract.apply_weighting(d.mentions())).select(
        "doc_id", "skill_id", F.round("confidence", 6).alias("confidence"),
        F.array_join("evidence", ",").alias("evidence"), "proficiency_hint")


@query("x11_extraction_metadata", f"""WITH {_TAGS},
r AS (SELECT doc_id, count(DISTINCT skill_id) AS n FROM tags GROUP BY 1)
SELECT d.doc_id, 1 AS chunks_processed, ceil(len({WORDS.format(c='text')}) * 1.3)::BIGINT AS tokens,
  (d.doc_id IN (SELECT doc_id FROM labels))::INT AS cache_hits,
  (d.doc_id NOT IN (SELECT doc_id FROM labels))::INT AS cache_misses, 0 AS sections_detected,
  coalesce(n, 0) AS skills_found FROM fx_docs d LEFT JOIN r USING (doc_id)""")
def _(d):
    chunks = _doc_chunks(d)
    cached = d.raw("labels").select("doc_id", F.lit(0).alias("chunk_index")).distinct()
    found = extract.merge_results(extract.extract(extract.tag_exact(
        chunks, _forms(d), carry=("section_weight",))))
    return extract.extraction_metadata(chunks, found, cached)


def _extracted(d, expand: bool = True):
    docs = d.job_docs().withColumnRenamed("source_type", "source")
    forms = d.raw("part").select(F.lower("p_name").alias("form")).distinct().select(
        F.concat(F.lit("W:"), "form").alias("skill_id"), "form")
    skills, edges = (d.skills(), d.edges()) if expand else (None, None)
    return extract.extract_documents(docs, forms, skills, edges, expand=expand)


# A part name counts once per document, at the best weight of the sections that list it.
@query("x12_extract_documents", """
WITH m AS (SELECT doc_id, concat('W:', lower(evidence)) AS skill_id, max(CASE source_type WHEN 'jd' THEN
    CASE section WHEN 'requirements' THEN 1.0 WHEN 'nice_to_have' THEN 0.75 ELSE 0.5 END WHEN 'cv' THEN
    CASE section WHEN 'requirements' THEN 1.0 WHEN 'nice_to_have' THEN 0.9 ELSE 0.8 END ELSE 1.0 END)::DOUBLE
  AS confidence FROM fx_mentions GROUP BY 1, 2)
SELECT doc_id, skill_id, confidence, false AS is_expanded, count(*) OVER (PARTITION BY doc_id) AS total_before
FROM m WHERE confidence >= 0.5""")
def _(d):
    return _extracted(d)["skills"].drop("expansion_type")


# The batch job over the documents table itself (texts without headings, so every weight is 1).
@query("x12_extract_texts", f"""WITH {_TAGS}
SELECT DISTINCT doc_id, skill_id, 1.0::DOUBLE AS confidence FROM tags""")
def _(d):
    out = extract.extract_documents(d.docs(), _forms(d), None, None, expand=False, max_chars=None)
    return out["skills"].select("doc_id", "skill_id", "confidence")


@query("x12_extract_metadata", f"""
WITH p AS (SELECT doc_id, source_type, unnest(CASE WHEN source_type = 'course' THEN [text] ELSE string_split(text, E'\\n\\n') END) AS piece
  FROM fx_job_docs),
c AS (SELECT doc_id, source_type, count(*) AS n, sum(ceil(len({WORDS.format(c='piece')}) * 1.3))::BIGINT AS tokens FROM p GROUP BY 1, 2),
k AS (SELECT doc_id, count(DISTINCT lower(evidence)) AS n FROM fx_mentions GROUP BY 1)
SELECT c.doc_id, c.n AS chunks_processed, tokens, 0::BIGINT AS cache_hits, c.n AS cache_misses,
  CASE WHEN source_type = 'course' THEN 0 ELSE c.n END AS sections_detected,
  CASE WHEN source_type = 'course' THEN 'generic' ELSE source_type END AS doc_type, coalesce(k.n, 0) AS skills_found
FROM c LEFT JOIN k ON k.doc_id = c.doc_id""")
def _(d):
    return _extracted(d, expand=False)["metadata"]  # counts what was found in the text itself
