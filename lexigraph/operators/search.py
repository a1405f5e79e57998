"""Vector, fuzzy, keyword and hybrid search over concepts; many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.functions.text import normalized_name, trigram_similarity, trigrams
from lexigraph.functions.vectors import nearest
from lexigraph.plans.scale import top_k

DESC, ID = F.desc, "id"


def _searchable(skills: DataFrame) -> DataFrame:
    return skills.filter("status = 'active' and embedding is not null")


def knn(queries: DataFrame, skills: DataFrame, k: int, by_category: bool = False,
        exclude_self: bool = True, exclude: DataFrame | None = None) -> DataFrame:
    """V1: the ``k`` most similar active concepts per query (query_id, id, similarity, rank)."""
    kept = _searchable(skills)
    if exclude is not None:
        kept = kept.join(exclude.select("id"), "id", "left_anti")
    if by_category:
        return nearest(queries.withColumnRenamed("category", "grp"), kept.withColumnRenamed("category", "grp"), k,
                       same_group=True, exclude_self=exclude_self)
    return nearest(queries, kept, k, exclude_self=exclude_self)


def knn_aliases(queries: DataFrame, alias_vectors: DataFrame, skills: DataFrame, k: int) -> DataFrame:
    """V2: the ``k`` most similar aliases of active concepts, with the concept they name."""
    act = skills.filter("status = 'active'").select(F.col("id").alias("skill_id"), "canonical_name")
    mine = alias_vectors.join(act.select("skill_id"), "skill_id", "left_semi")
    found = nearest(queries, mine.select("id", "embedding"), k)
    return found.join(mine.select("id", "skill_id"), "id").join(act, "skill_id").withColumnRenamed("id", "alias_id")


def candidates(chunks: DataFrame, skills: DataFrame, k: int = config.CANDIDATE_LIMIT,
               keyword_docs: DataFrame | None = None) -> DataFrame:
    """V3: the concepts offered to the extraction step per chunk; a chunk without a vector uses keywords."""
    found = knn(chunks, skills, k, exclude_self=False).select("query_id", "id", "similarity", "rank")
    if keyword_docs is not None:
        bare = chunks.filter("embedding is null").select(F.col("query_id"), F.explode(F.array_distinct(
            F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).filter("word <> ''")
        terms = keyword_docs.filter("status = 'active'").select("id", F.explode(F.array_distinct(
            F.split(F.lower("canonical_name"), r"[^\p{L}\p{N}]+"))).alias("word"))
        size = F.size(F.array_distinct(F.split(F.lower("canonical_name"), r"[^\p{L}\p{N}]+")))
        share = (bare.join(terms, "word").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))
                 .join(keyword_docs.select("id", size.alias("words")), "id")
                 .select("query_id", "id", F.round(F.col("n") / F.col("words"), 6).alias("similarity")))
        found = found.unionByName(top_k(share, ["query_id"], [F.desc("similarity"), F.col("id")], k))
    info = skills.select("id", "external_id", "canonical_name", "description")
    return found.join(info, "id")


def check_duplicates(cands: DataFrame, skills: DataFrame, alias_vectors: DataFrame,
                     duplicate: float = config.DUPLICATE_SIMILARITY,
                     review: float = config.REVIEW_SIMILARITY) -> DataFrame:
    """V4: the closest concept of each candidate by name or alias, and what that makes the candidate."""
    by_name = knn(cands, skills, 1, exclude_self=False).select(
        "query_id", F.col("id").alias("skill_id"), "similarity")
    by_alias = knn_aliases(cands, alias_vectors, skills, 1).select("query_id", "skill_id", "similarity")
    best = top_k(by_name.unionByName(by_alias), ["query_id"], [F.desc("similarity"), F.col("skill_id")], 1)
    all_cands = cands.select(F.col("query_id").cast("string").alias("query_id"))
    s = F.col("similarity")
    verdict = F.when(s >= duplicate, "duplicate").when(s >= review, "review").otherwise("unique")
    return all_cands.join(best.drop("rank"), "query_id", "left").withColumn("verdict", verdict)


def similar_pairs(vectors: DataFrame, high: float = config.RELATED_HIGH_SIMILARITY,
                  low: float = config.RELATED_LOW_SIMILARITY) -> DataFrame:
    """V5: pairs of related concepts, exact. Equal vectors are compared once.

    Concepts with the very same vector are linked to the smallest id among them ("identical"), and only that
    one meets the others, so a large group of copies adds one row each, not all its pairs.
    """
    # The first id per vector stands for all of its copies.
    keyed = vectors.filter("embedding is not null").select(
        F.col("id").cast("string").alias("id"), "embedding", F.xxhash64("embedding").alias("__h"))
    reps = keyed.groupBy("__h", "embedding").agg(F.min("id").alias("rep"))
    copies = keyed.join(reps, ["__h", "embedding"]).filter("id <> rep").select(
        F.col("rep").alias("skill_a_id"), F.col("id").alias("skill_b_id"), F.lit(1.0).alias("similarity"),
        F.lit("identical").alias("relation"))
    v = reps.select(F.col("rep").alias("id"), "embedding")
    found = nearest(v.withColumnRenamed("id", "query_id"), v, None, low, exclude_self=True, later=True)
    s = F.col("similarity")
    pairs = found.filter("query_id < id").select(
        F.col("query_id").alias("skill_a_id"), F.col("id").alias("skill_b_id"), "similarity",
        F.when(s >= high, "related_high").otherwise("related_medium").alias("relation"))
    return pairs.unionByName(copies).withColumn(
        "possible_duplicate", F.col("similarity") >= config.RELATED_HIGH_SIMILARITY)


def _ordered_grams(rows: DataFrame, key: str, freq: DataFrame) -> DataFrame:
    """Trigrams per string, the rarest first (strings are short, so are the arrays)."""
    flat = rows.select(key, F.explode("grams").alias("gram")).join(freq, "gram", "left")
    return flat.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))),
        lambda x: x["gram"]).alias("grams"))


def trigram_matches(queries: DataFrame, forms: DataFrame, least: float = config.TRIGRAM_THRESHOLD) -> DataFrame:
    """Pairs (q, form, similarity) at or above ``least``; both inputs hold distinct strings.

    Two sets that similar must share one of their rarest trigrams, so only that many trigrams of each string
    are joined; common trigrams never meet each other. Candidates are then compared in full.
    """
    q = queries.select("q", trigrams(F.col("q")).alias("grams")).filter("size(grams) > 0")
    f = forms.select("form", trigrams(F.col("form")).alias("grams")).filter("size(grams) > 0")
    freq = f.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    qo, fo = _ordered_grams(q, "q", freq), _ordered_grams(f, "form", freq)
    head = F.size("grams") - F.ceil(F.size("grams") * F.lit(least) - F.lit(1e-9)).cast("int") + 1
    ql = qo.select("q", F.size("grams").alias("nq"), F.explode(F.slice("grams", F.lit(1), head)).alias("gram"))
    fl = fo.select("form", F.size("grams").alias("nf"), F.explode(F.slice("grams", F.lit(1), head)).alias("gram"))
    near = (F.col("nf") >= F.col("nq") * F.lit(least) - 1e-9) & (F.col("nq") >= F.col("nf") * F.lit(least) - 1e-9)
    cand = ql.join(fl, "gram").filter(near).select("q", "form").distinct()
    both = (cand.join(qo.withColumnRenamed("grams", "gq"), "q").join(fo.withColumnRenamed("grams", "gf"), "form"))
    sim = F.round(trigram_similarity(F.col("gq"), F.col("gf")), 6)
    return both.select("q", "form", sim.alias("similarity")).filter(F.col("similarity") >= least)


def name_forms(skills: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(id, form) of every name and alias in comparison form."""
    names = skills.select("id", normalized_name(F.col("canonical_name")).alias("form"))
    if aliases is None:
        return names.distinct()
    more = aliases.select(F.col("skill_id").alias("id"), normalized_name(F.col("surface_form")).alias("form"))
    return names.unionByName(more).distinct()


def trigram_search(queries: DataFrame, forms: DataFrame, least: float = config.TRIGRAM_THRESHOLD,
                   limit: int = config.PAGE_LIMIT) -> DataFrame:
    """V9: best concepts per query string by trigram similarity of a name or alias.

    Only the first ``limit`` concepts of a form can be on the page, so a form many concepts share stays small.
    """
    matches = trigram_matches(queries.select("q").distinct(), forms.select("form").distinct(), least)
    few = top_k(forms, ["form"], [F.col("id")], limit).drop("rank")
    rows = matches.join(few, "form").groupBy("q", "id").agg(F.max("similarity").alias("similarity"))
    return top_k(rows, ["q"], [F.desc("similarity"), F.col("id")], limit)


# Fixed values (ours): score of a keyword hit by the way it matched.
TIERS = {"exact name": 5, "exact alias": 4, "prefix": 3, "typo": 2, "description": 1}


def _words(col: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def _slack(q: Column) -> Column:
    """Typos allowed in a query: two a word of five letters or more, one a word of three or four, none in shorter ones."""
    return F.aggregate(_words(q), F.lit(0), lambda n, w: n + F.when(F.length(w) >= 5, 2).when(F.length(w) >= 3, 1).otherwise(0))


def typo_matches(queries: DataFrame, forms: DataFrame) -> DataFrame:
    """Pairs (q, form) within the query's slack in edit distance; both inputs hold distinct strings. No pair is lost.

    A query is cut into one piece more than it may have typos, so one piece stands unchanged in the form, moved by that many
    places at most. Pieces are joined with the forms' substrings of the same length and place, then compared in full.
    """
    d, size = F.col("d"), F.length("q")
    cut_at = lambda i: F.floor(i * F.col("n") / (d + 1)).cast("int")
    q = queries.select("q", _slack(F.col("q")).alias("d"), size.alias("n")).filter("d > 0 and n > d")
    piece = F.transform(F.sequence(F.lit(0), d), lambda i: F.struct(
        cut_at(i).alias("at"), (cut_at(i + 1) - cut_at(i)).alias("size")))
    flat = q.select("q", "d", "n", F.explode(piece).alias("p")).select("q", "d", "n", F.col("p.at").alias("at0"), F.col("p.size").alias("size"))
    flat = flat.withColumn("piece", F.substring(F.col("q"), F.col("at0") + 1, F.col("size")))
    sizes = sorted(r["size"] for r in flat.select("size").distinct().collect())  # no more than the longest query has letters
    if not sizes:
        return queries.select("q", F.col("q").alias("form")).limit(0)
    moved = flat.select("q", "d", "n", "piece", F.explode(F.sequence(F.greatest(F.col("at0") - d, F.lit(0)), F.col("at0") + d)).alias("at"))
    none = F.expr("cast(array() as array<struct<at:int,piece:string>>)")

    def spots(m: int) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.length("form") - m), lambda i: F.struct(
            i.alias("at"), F.substring(F.col("form"), i + 1, F.lit(m)).alias("piece")))
        return F.when(F.length("form") >= m, found).otherwise(none)

    parts = forms.select("form", F.explode(F.flatten(F.array(*[spots(m) for m in sizes]))).alias("s")).select("form", "s.at", "s.piece")
    near = moved.join(parts, ["piece", "at"]).filter(F.abs(F.length("form") - F.col("n")) <= d).select("q", "d", "form").distinct()
    return near.filter(F.levenshtein("q", "form") <= d).select("q", "form")


def highlight(name: Column, q: Column) -> Column:
    """The name with the first place where it holds the query marked."""
    at = F.instr(F.lower(name), q)
    n = F.length(q)
    marked = F.concat(F.substring(name, F.lit(1), at - 1), F.lit("<mark>"), F.substring(name, at, n),
                      F.lit("</mark>"), F.substring(name, at + n, F.length(name)))
    return F.when(at > 0, marked).otherwise(name)


def keyword_search(queries: DataFrame, skills: DataFrame, aliases: DataFrame, limit: int = config.PAGE_LIMIT,
                   category: str | None = None, status: str = "active") -> DataFrame:
    """Exact, prefix, typo-tolerant and description hits per query, best tier first, id breaks ties.

    Every kind of hit is an equi-join: on the form, on the exploded prefixes, on pieces that a typo leaves whole, on
    the rarest query word in descriptions.
    """
    docs = skills.filter(F.col("status") == status)
    if category is not None:
        docs = docs.filter(F.col("category") == category)
    q = queries.select(normalized_name(F.col("q")).alias("q")).filter("q <> ''").distinct()
    names = name_forms(docs)
    alias_forms = name_forms(docs.join(aliases.select(F.col("skill_id").alias("id")), "id", "left_semi"),
                             aliases.join(docs.select(F.col("id").alias("skill_id")), "skill_id", "left_semi"))

    def hit(rows: DataFrame, tier: str) -> DataFrame:
        return rows.select("q", "id", F.lit(TIERS[tier]).alias("score"))

    exact = hit(q.join(names.withColumnRenamed("form", "q"), "q"), "exact name")
    alias = hit(q.join(alias_forms.withColumnRenamed("form", "q"), "q"), "exact alias")
    starts = F.array_distinct(F.concat(F.array("form"), _words(F.col("form"))))
    heads = F.flatten(F.transform(starts, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, F.lit(1), i))))
    # Prefixes are taken of distinct forms; a form many concepts share is exploded once.
    prefixes = alias_forms.unionByName(names).select("form").distinct().select(
        "form", F.explode(F.array_distinct(heads)).alias("q"))
    all_forms = alias_forms.unionByName(names).distinct()
    prefix = hit(q.join(prefixes, "q").join(all_forms, "form"), "prefix")
    typo = hit(typo_matches(q, all_forms.select("form").distinct()).join(all_forms, "form"), "typo")
    text = docs.filter("description is not null").select("id", _words(F.col("description")).alias("words"))
    said = text.select("id", F.explode("words").alias("w"))
    freq = said.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rare = top_k(q.select("q", F.explode(_words(F.col("q"))).alias("w")).join(freq, "w", "left"), ["q"],
                 [F.coalesce("df", F.lit(0)), F.col("w")], 1)
    in_text = (rare.select("q", "w").join(said, "w").join(text, "id")
               .filter(F.size(F.array_except(_words(F.col("q")), F.col("words"))) == 0))
    hits = exact
    for rows in (alias, prefix, typo, hit(in_text, "description")):
        hits = hits.unionByName(rows)
    best = hits.groupBy("q", "id").agg(F.max("score").alias("score"))
    page = top_k(best, ["q"], [F.desc("score"), F.col("id")], limit)
    shown = page.join(docs.select("id", "canonical_name"), "id")
    return shown.withColumn("highlight", highlight(F.col("canonical_name"), F.col("q")))


def hybrid_search(keyword: DataFrame, semantic: DataFrame, k: int = config.RRF_K,
                  limit: int = config.PAGE_LIMIT) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (query_id, id, rank)."""
    kw = keyword.select("query_id", "id", F.col("rank").alias("kr"))
    se = semantic.select("query_id", "id", F.col("rank").alias("sr"))
    both = kw.join(se, ["query_id", "id"], "full_outer")

    def part(c: str) -> Column:
        return F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))

    kind = F.when(F.col("sr").isNull(), "keyword").when(F.col("kr").isNull(), "semantic").otherwise("both")
    scored = both.select("query_id", "id", F.round(part("kr") + part("sr"), 9).alias("score"),
                         kind.alias("match_type"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("id")], limit)


def facets(docs: DataFrame) -> DataFrame:
    """Number of concepts per category and per status, in one pass."""
    return (docs.groupingSets([["category"], ["status"]], "category", "status")
            .agg(F.count(F.lit(1)).alias("n"), F.grouping("category").alias("g"))
            .select(F.when(F.col("g") == 0, "category").otherwise("status").alias("facet"),
                    F.when(F.col("g") == 0, F.col("category")).otherwise(F.col("status")).alias("value"), "n"))


def expand_query(queries: DataFrame, forms: DataFrame) -> DataFrame:
    """Other forms of the concepts a query names."""
    named = queries.select("q").distinct().join(forms.select(F.col("form").alias("q"), "id"), "q")
    return named.join(forms, "id").filter("form <> q").select("q", F.col("form").alias("expansion")).distinct()


def suggest_parents(cands: DataFrame, skills: DataFrame, edges: DataFrame, neighbours: int = 5,
                    k: int = 3) -> DataFrame:
    """Parents of the nearest concepts, ranked by their summed similarity."""
    from lexigraph.operators.graph import hierarchy

    near = knn(cands, skills, neighbours).select("query_id", F.col("id").alias("child_id"), "similarity")
    votes = (near.join(hierarchy(edges), "child_id").groupBy("query_id", "parent_id")
             .agg(F.round(F.sum("similarity"), 6).alias("votes")))
    return top_k(votes, ["query_id"], [F.desc("votes"), F.col("parent_id")], k)
