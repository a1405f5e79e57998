"""Vector, fuzzy, keyword and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import vectors
from lexigraph.operators import search
from lexigraph.plans.registry import query


def sim(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}.embedding, {b}.embedding), 6)"


_ACTIVE = "k.status = 'active' AND k.embedding IS NOT NULL"


def as_queries(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "query_id")


def waiting(d) -> DataFrame:
    """Leaves that are still candidates, as search queries."""
    return as_queries(d.skills().filter("status = 'candidate'"))


def _knn_sql(extra: str, k: int) -> str:
    return f"""
WITH s AS (SELECT c.id AS query_id, k.id, {sim('c', 'k')} AS similarity FROM fx_skills c JOIN fx_skills k
  ON {_ACTIVE} AND c.status = 'candidate' {extra})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
WHERE rank <= {k}"""


@query("v1_knn", _knn_sql("", 10))
def _(d):
    return search.knn(waiting(d), d.skills(), 10)


@query("v1_knn_category", _knn_sql("AND c.category = k.category", 5))
def _(d):
    return search.knn(waiting(d), d.skills(), 5, by_category=True)


@query("v2_knn_aliases", f"""
WITH s AS (SELECT v.id AS query_id, a.id AS alias_id, a.skill_id, {sim('v', 'a')} AS similarity
  FROM fx_vectors v JOIN fx_alias_vectors a ON a.skill_id IN (SELECT id FROM fx_skills WHERE status = 'active'))
SELECT query_id, alias_id, skill_id, canonical_name, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, alias_id) AS rank FROM s)
JOIN fx_skills k ON k.id = skill_id WHERE rank <= 5""")
def _(d):
    return search.knn_aliases(as_queries(d.vectors()), d.alias_vectors(), d.skills(), 5)


@query("v3_candidates", f"""
WITH s AS (SELECT v.id AS query_id, k.id, external_id, canonical_name, description, {sim('v', 'k')} AS similarity
  FROM fx_vectors v JOIN fx_skills k ON {_ACTIVE})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
WHERE rank <= 100""")
def _(d):
    return search.candidates(as_queries(d.vectors()), d.skills())


V4_SQL = f"""
n AS (SELECT v.id AS query_id, k.id AS skill_id, {sim('v', 'k')} AS similarity FROM fx_vectors v
  JOIN fx_skills k ON {_ACTIVE}),
a AS (SELECT v.id AS query_id, x.skill_id, x.id AS alias_id, {sim('v', 'x')} AS similarity FROM fx_vectors v
  JOIN fx_alias_vectors x ON x.skill_id IN (SELECT id FROM fx_skills WHERE status = 'active')),
u AS (
  SELECT query_id, skill_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY similarity DESC, skill_id) AS r FROM n) WHERE r = 1
  UNION ALL SELECT query_id, skill_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY similarity DESC, alias_id) AS r FROM a) WHERE r = 1),
verdicts AS (
  SELECT query_id, skill_id, similarity, CASE WHEN similarity >= 0.9 THEN 'duplicate'
    WHEN similarity >= 0.7 THEN 'review' ELSE 'unique' END AS verdict FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, skill_id) AS r FROM u) WHERE r = 1)"""


@query("v4_check_duplicates", f"WITH {V4_SQL} SELECT * FROM verdicts")
def _(d):
    return search.check_duplicates(as_queries(d.vectors()), d.skills(), d.alias_vectors())


def pairs_sql(source: str, low: float) -> str:
    return f"""
reps AS (SELECT embedding, min(id) AS id FROM {source} WHERE embedding IS NOT NULL GROUP BY embedding),
pairs AS (
  SELECT a.id AS skill_a_id, b.id AS skill_b_id, {sim('a', 'b')} AS similarity FROM reps a JOIN reps b ON a.id < b.id),
related_pairs AS (
  SELECT *, CASE WHEN similarity >= 0.85 THEN 'related_high' ELSE 'related_medium' END AS relation
  FROM pairs WHERE similarity >= {low}
  UNION ALL SELECT r.id, s.id, 1.0::DOUBLE, 'identical' FROM reps r JOIN {source} s
  ON r.embedding = s.embedding AND r.id <> s.id)"""


@query("v5_similar_pairs", f"WITH {pairs_sql('fx_vectors', 0.65)} SELECT *, similarity >= 0.85 AS possible_duplicate "
       "FROM related_pairs")
def _(d):
    return search.similar_pairs(d.vectors())


@query("v5_similar_skills", f"WITH {pairs_sql('fx_skills', 0.35)} SELECT *, similarity >= 0.85 AS possible_duplicate "
       "FROM related_pairs")
def _(d):
    return search.similar_pairs(d.skills().select("id", "embedding"), low=0.35)


@query("v6_cosine", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(d):
    a = d.raw("embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6)
                                      .alias("similarity"))


@query("v7_truncate", """
WITH h AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, len(e) AS dims, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first_value,
  round(e[32] / sqrt(list_dot_product(e, e)), 6) AS last_value FROM h""")
def _(d):
    t = d.raw("embeddings").select("vec_id", vectors.truncate(F.col("embedding"), 32).alias("e"))
    return t.select("vec_id", F.size("e").cast("bigint").alias("dims"), F.round(F.col("e")[0], 6).alias("first_value"),
                    F.round(F.col("e")[31], 6).alias("last_value"))


# Query strings made of the part names: as they are, their start, one word, and with a letter missing.
_Q = """
q AS (SELECT DISTINCT unnest([lower(p_name), substr(lower(p_name), 1, 3), split_part(lower(p_name), ' ', 2),
  concat(substr(lower(p_name), 1, 3), substr(lower(p_name), 5))]) AS q FROM part)"""


def name_queries(d) -> DataFrame:
    n = F.lower("p_name")
    return d.raw("part").select(F.explode(F.array(
        n, F.substring(n, 1, 3), F.split_part(n, F.lit(" "), F.lit(2)),
        F.concat(F.substring(n, 1, 3), F.expr("substring(lower(p_name), 5)")))).alias("q")).distinct()


def _grams(col: str) -> str:
    return f"""list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({col}),
  '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1),
  lambda i: substr('  ' || w || ' ', i, 3)))))"""


_TRI = f"""
qg AS (SELECT q, {_grams('q')} AS gq FROM q),
fg AS (SELECT form, {_grams('form')} AS gf FROM (SELECT DISTINCT form FROM forms)),
tri AS (SELECT q, form, round(len(list_intersect(gq, gf)) / (len(gq) + len(gf) - len(list_intersect(gq, gf))), 6)
  AS similarity FROM qg, fg)"""
_FORMS = """
forms AS (SELECT id, lower(canonical_name) AS form FROM fx_skills WHERE status = 'active'
  UNION SELECT skill_id, lower(surface_form) FROM fx_aliases
  WHERE skill_id IN (SELECT id FROM fx_skills WHERE status = 'active'))"""


def _forms(d) -> DataFrame:
    act = d.skills().filter("status = 'active'")
    return search.name_forms(act, d.aliases().join(act.select(F.col("id").alias("skill_id")), "skill_id", "left_semi"))


@query("v9_trigram_search", f"""
WITH {_Q}, {_FORMS}, {_TRI},
r AS (SELECT q, id, max(similarity) AS similarity FROM tri JOIN forms USING (form) WHERE similarity >= 0.3
  GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, id) AS rank FROM r)
WHERE rank <= 20""")
def _(d):
    return search.trigram_search(name_queries(d), _forms(d))


_KEYWORD = f"""
{_Q}, {_FORMS},
docs AS (SELECT * FROM fx_skills WHERE status = 'active'),
wq AS (SELECT q, list_distinct(list_filter(regexp_split_to_array(q, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))
  AS words FROM q),
hits AS (
  SELECT q, id, 5 AS score FROM q JOIN docs ON lower(canonical_name) = q
  UNION ALL SELECT q, id, 4 FROM q JOIN forms ON form = q
  UNION ALL SELECT q, id, 3 FROM q JOIN forms ON starts_with(form, q) OR len(list_filter(
    regexp_split_to_array(form, '[^\\p{{L}}\\p{{N}}]+'), lambda w: starts_with(w, q))) > 0
  UNION ALL SELECT q, id, 2 FROM wq JOIN forms ON levenshtein(q, form) <= list_sum(list_transform(words, lambda w:
    CASE WHEN length(w) >= 5 THEN 2 WHEN length(w) >= 3 THEN 1 ELSE 0 END))
  UNION ALL SELECT q, id, 1 FROM wq JOIN docs ON description IS NOT NULL AND len(list_intersect(words,
    regexp_split_to_array(lower(description), '[^\\p{{L}}\\p{{N}}]+'))) = len(words)),
best AS (SELECT q, id, max(score) AS score FROM hits GROUP BY 1, 2),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM best)
  WHERE rank <= 20)"""


@query("v10_keyword_search", f"""
WITH {_KEYWORD}
SELECT q, id, score, rank, canonical_name, CASE WHEN instr(lower(canonical_name), q) > 0 THEN
  concat(substr(canonical_name, 1, instr(lower(canonical_name), q) - 1), '<mark>',
    substr(canonical_name, instr(lower(canonical_name), q), length(q)), '</mark>',
    substr(canonical_name, instr(lower(canonical_name), q) + length(q))) ELSE canonical_name END AS highlight
FROM kw JOIN fx_skills USING (id)""")
def _(d):
    return search.keyword_search(name_queries(d), d.skills(), d.aliases())


def _query_vectors(d) -> DataFrame:
    """A stand-in vector per query string: that of the first part with the name."""
    first = d.raw("part").groupBy(F.lower("p_name").alias("query_id")).agg(F.min("p_partkey").alias("k"))
    return (first.withColumn("id", F.expr("concat('P:', k)")).join(d.skills().select("id", "embedding"), "id")
            .select("query_id", "embedding"))


@query("v11_hybrid_search", f"""
WITH {_KEYWORD},
qv AS (SELECT q AS query_id, embedding FROM (SELECT lower(p_name) AS q, min(p_partkey) AS k FROM part GROUP BY 1)
  JOIN fx_skills s ON s.id = concat('P:', k)),
se AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
  SELECT query_id, k.id, round(list_cosine_similarity(qv.embedding, k.embedding), 6) AS similarity
  FROM qv JOIN fx_skills k ON {_ACTIVE})) WHERE rank <= 20),
f AS (SELECT coalesce(kw.q, se.query_id) AS query_id, coalesce(kw.id, se.id) AS id,
  round(coalesce(1 / (60 + kw.rank), 0) + coalesce(1 / (60 + se.rank), 0), 9) AS score,
  CASE WHEN se.rank IS NULL THEN 'keyword' WHEN kw.rank IS NULL THEN 'semantic' ELSE 'both' END AS match_type
  FROM kw FULL JOIN se ON kw.q = se.query_id AND kw.id = se.id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)
WHERE rank <= 20""")
def _(d):
    kw = search.keyword_search(name_queries(d), d.skills(), d.aliases()).withColumnRenamed("q", "query_id")
    se = search.knn(_query_vectors(d), d.skills(), 20, exclude_self=False)
    return search.hybrid_search(kw, se)


@query("v12_facets", """
SELECT 'category' AS facet, category AS value, count(*) AS n FROM fx_skills GROUP BY category
UNION ALL SELECT 'status', status, count(*) FROM fx_skills GROUP BY status""")
def _(d):
    return search.facets(d.skills())


@query("v13_expand_query", f"""
WITH {_FORMS}
SELECT DISTINCT a.form AS q, b.form AS expansion FROM (SELECT DISTINCT lower(p_name) AS q FROM part) x
JOIN forms a ON a.form = x.q JOIN forms b ON a.id = b.id WHERE a.form <> b.form""")
def _(d):
    return search.expand_query(d.raw("part").select(F.lower("p_name").alias("q")), _forms(d))


@query("v14_suggest_parents", f"""
WITH s AS (SELECT c.id AS query_id, k.id, {sim('c', 'k')} AS similarity FROM fx_skills c JOIN fx_skills k
  ON {_ACTIVE} AND c.status = 'candidate'),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM s)
  WHERE r <= 5),
v AS (SELECT query_id, parent_id, round(sum(similarity), 6) AS votes FROM n JOIN fx_hierarchy ON child_id = n.id
  GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, parent_id) AS rank FROM v)
WHERE rank <= 3""")
def _(d):
    return search.suggest_parents(waiting(d), d.skills(), d.edges())
