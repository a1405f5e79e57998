"""From documents to concepts: sections, chunks, tags, weights, merged results.

A document is one row; sections and chunks are built inside the row with array functions, so splitting text
needs no shuffle.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph import config
from lexigraph.functions.text import SENTENCE_MARK, clean_html, clean_plain, estimate_tokens, let, name_tokens
from lexigraph.plans.scale import cut, fits

SECTION = "struct<name:string,type:string,weight:double,start_offset:int,end_offset:int>"


def clean_documents(docs: DataFrame, fmt: str = "plain") -> DataFrame:
    """S5 on the text column."""
    return docs.withColumn("text", clean_html(F.col("text")) if fmt == "html" else clean_plain(F.col("text")))


def _heading_map() -> Column:
    pairs = [(word, F.struct(F.lit(doc).alias("doc"), F.lit(kind).alias("type"), F.lit(weight).alias("weight")))
             for doc, kind, weight, words in config.SECTION_RULES for word in words.split("|")]
    return F.create_map(*chain.from_iterable((F.lit(w), s) for w, s in pairs))


def detect_sections(docs: DataFrame) -> DataFrame:
    """Document type from its headings, and the weighted sections with their character offsets.

    A heading is a line that holds nothing but a heading word, with or without leading ``#`` or a final colon.
    The type with more headings wins (job description on a tie); its headings open the sections.
    """
    longest = 20 + max(len(w) for rule in config.SECTION_RULES for w in rule[3].split("|"))

    def heads(lines: Column) -> Column:
        numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("i")))
        short = F.filter(numbered, lambda x: (F.length(x["line"]) > 0) & (F.length(x["line"]) <= longest))
        ruled = F.transform(short, lambda x: F.struct(
            x["line"].alias("line"), x["i"].alias("i"), F.element_at(
                _heading_map(), F.lower(F.regexp_replace(F.trim(x["line"]), r"^#+\s*|\s*:$", ""))).alias("r")))
        return F.transform(F.filter(ruled, lambda x: x["r"].isNotNull()), lambda x: F.struct(
            x["line"].alias("name"), x["r"]["doc"].alias("doc"), x["r"]["type"].alias("type"),
            x["r"]["weight"].alias("weight"),
            (F.length(F.array_join(F.slice(lines, F.lit(1), x["i"]), "\n"))
             + F.when(x["i"] > 0, 1).otherwise(0)).alias("start")))

    def count(found: Column, doc: str) -> Column:
        return F.size(F.filter(found, lambda h: h["doc"] == doc))

    def kind(found: Column) -> Column:
        return (F.when(F.size(found) == 0, "generic")
                .when(count(found, "jd") >= count(found, "cv"), "jd").otherwise("cv"))

    def sections(mine: Column) -> Column:
        return F.transform(mine, lambda h, i: F.struct(
            h["name"].alias("name"), h["type"].alias("type"), h["weight"].alias("weight"),
            h["start"].alias("start_offset"),
            F.coalesce(F.get(mine, i + 1)["start"], F.length("text")).alias("end_offset")))

    def describe(found: Column) -> Column:
        return let(kind(found), lambda k: F.struct(k.alias("doc_type"), let(
            F.filter(found, lambda h: h["doc"] == k), sections).alias("sections")))

    marked = docs.withColumn("__s", let(F.split("text", "\n"), lambda lines: let(heads(lines), describe)))
    return marked.select(*docs.columns, F.col("__s.doc_type").alias("doc_type"),
                         F.col("__s.sections").cast(f"array<{SECTION}>").alias("sections"))


def explode_sections(docs: DataFrame) -> DataFrame:
    """One row per detected section."""
    return docs.select("doc_id", "doc_type", F.explode_outer("sections").alias("s")).filter("s is not null").select(
        "doc_id", "doc_type", F.col("s.name").alias("section_name"), F.col("s.type").alias("section_type"),
        F.col("s.weight").alias("weight"), F.col("s.start_offset").alias("start_offset"),
        F.col("s.end_offset").alias("end_offset"))


def _words(n_tokens: int) -> int:
    return int(n_tokens / config.TOKENS_PER_WORD)


def _windows(text: Column, start: Column, size: int, overlap: int, snap: bool) -> Column:
    """Overlapping word windows of a text as structs of offsets (``start`` is added to each)."""
    span, step = _words(size), _words(size) - _words(overlap)

    def end_of(words: Column, at: Column) -> Column:
        full = F.least(at + span, F.size(words))
        if not snap:
            return full
        # A sentence end within the overlap, so that no word is lost between windows.
        later = F.reverse(F.slice(words, at + step, span - step + 1))
        back = F.array_position(F.transform(later, lambda w: w.rlike(r"[.!?]\s*$")), True)
        snapped = F.when(back > 0, full - back.cast("int") + 1).otherwise(full)
        return F.when((full < F.size(words)) & (full >= at + step), snapped).otherwise(full)

    def windows(words: Column) -> Column:
        last = F.greatest(F.size(words) - _words(overlap) - 1, F.lit(0))
        firsts = F.when(F.size(words) > 0, F.sequence(F.lit(0), last, F.lit(step)))
        sizes = F.transform(words, lambda w: F.length(w))
        total = lambda a, frm, n: F.aggregate(F.slice(a, frm, n), F.lit(0), lambda x, y: x + y)
        def heads(lens: Column) -> Column:
            """Where each window starts: the sum of the words before it, carried on from window to window."""
            at_ = lambda a, at: a["sum"] + F.when(at > 0, total(lens, at - step + 1, F.lit(step))).otherwise(0)
            return F.aggregate(firsts, F.struct(F.lit(0).alias("sum"), F.expr("cast(array() as array<int>)").alias("all")),
                               lambda a, at: F.struct(at_(a, at).alias("sum"), F.concat(a["all"], F.array(at_(a, at))).alias("all")),
                               lambda a: a["all"])

        return let(sizes, lambda lens: let(heads(lens), lambda head: F.transform(firsts, lambda at, i: let(
            F.struct(F.get(head, i).alias("head"), end_of(words, at).alias("end")), lambda x: F.struct(
                (start + x["head"]).alias("start_offset"),
                (start + x["head"] + total(lens, at + 1, x["end"] - at)).alias("end_offset"))))))

    none = F.expr("cast(array() as array<struct<start_offset:int,end_offset:int>>)")
    return F.coalesce(let(F.regexp_extract_all(text, F.lit(r"\S+\s*"), 0), windows), none)


def chunk_sliding(docs: DataFrame, size: int = config.CHUNK_TARGET_TOKENS,
                  overlap: int = config.CHUNK_OVERLAP_TOKENS, snap: bool = True) -> DataFrame:
    """Overlapping windows over the whole text, ended at a sentence end where the overlap allows."""
    return _chunk_rows(docs.withColumn("__chunks", F.transform(
        _windows(F.col("text"), F.lit(0), size, overlap, snap), lambda c: F.struct(
            c["start_offset"].alias("start_offset"), c["end_offset"].alias("end_offset"),
            F.lit(None).cast("string").alias("type"), F.lit(1.0).alias("weight")))))


def _chunk_rows(docs: DataFrame) -> DataFrame:
    keep = [c for c in docs.columns if c not in ("text", "sections", "__chunks")]
    # The outer form: for the plain one Spark would evaluate the whole array again to filter empty ones.
    rows = docs.select(*keep, "text", F.posexplode_outer("__chunks").alias("chunk_index", "c")).filter("c is not null")
    text = F.substring(F.col("text"), F.col("c.start_offset") + 1, F.col("c.end_offset") - F.col("c.start_offset"))
    return rows.select(
        *keep, "chunk_index", F.col("c.start_offset").alias("start_offset"),
        F.col("c.end_offset").alias("end_offset"), F.col("c.type").alias("section"),
        F.col("c.weight").alias("section_weight"), text.alias("text")).withColumn(
        "token_estimate", estimate_tokens(F.col("text")))


def _pack(text: Column, start: Column, boundary: str, target: int) -> Column:
    """Merge consecutive pieces of a text up to the target size; returns structs of offsets and tokens."""
    pieces = F.split(text, boundary)
    sized = F.transform(pieces, lambda p: F.struct(
        F.length(p).alias("len"),
        (F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) * F.lit(config.TOKENS_PER_WORD)).alias("tok")))
    none = "cast(array() as array<struct<start:int,len:int,tok:double>>)"
    first = F.struct(F.expr(none).alias("done"), start.cast("int").alias("start"), F.lit(0).alias("len"),
                     F.lit(0.0).alias("tok"))
    flushed = lambda a: F.concat(a["done"], F.array(F.struct(
        a["start"].alias("start"), a["len"].alias("len"), a["tok"].alias("tok"))))

    def step(a: Column, p: Column) -> Column:
        full = (a["tok"] > 0) & (a["tok"] + p["tok"] > target)
        return F.struct(
            F.when(full, flushed(a)).otherwise(a["done"]).alias("done"),
            F.when(full, a["start"] + a["len"]).otherwise(a["start"]).alias("start"),
            F.when(full, p["len"]).otherwise(a["len"] + p["len"]).alias("len"),
            F.when(full, p["tok"]).otherwise(a["tok"] + p["tok"]).alias("tok"))

    return F.aggregate(sized, first, step, lambda a: F.when(a["len"] > 0, flushed(a)).otherwise(a["done"]))


def _all_sections() -> Column:
    """The ``sections`` of a document and, before them, the text outside them (weight 1)."""
    lead = F.coalesce(F.get(F.col("sections"), F.lit(0))["start_offset"], F.length("text"))
    outside = F.when(lead > 0, F.array(F.struct(
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(1.0).alias("weight"),
        F.lit(0).alias("start_offset"), lead.alias("end_offset")))).otherwise(F.array())
    return F.concat(outside.cast(f"array<{SECTION}>"), F.col("sections"))


def whole_sections(docs: DataFrame) -> DataFrame:
    """Every section, and the text outside them, as one row (``chunk_index``: its place), to look names up in.

    The edge of a chunk may cut a name: one part of it alone would be found, or nothing. A section's edge is a heading.
    """
    return _chunk_rows(docs.withColumn("__chunks", F.transform(_all_sections(), lambda s: F.struct(
        s["start_offset"].alias("start_offset"), s["end_offset"].alias("end_offset"),
        s["type"].alias("type"), s["weight"].alias("weight")))))


# Where a text may be cut (the break stays with the piece that follows it).
STRUCTURAL_BREAKS = r"(?=\n\n)|(?=\n#)|(?=\n---)"
PARAGRAPH_BREAKS = r"(?=\n\n)"


def chunk_sections(docs: DataFrame, target: int = config.CHUNK_TARGET_TOKENS,
                   maximum: int = config.CHUNK_MAX_TOKENS, overlap: int = config.CHUNK_OVERLAP_TOKENS,
                   boundary: str = STRUCTURAL_BREAKS) -> DataFrame:
    """Chunks along sections and structural breaks; a chunk over the maximum is cut by sliding windows.

    Needs the ``sections`` of ``detect_sections``. Text outside them is chunked too, with weight 1. A section whose
    characters alone keep it within the target is one chunk; its words are not counted.
    """
    def cut_section(s: Column) -> Column:
        body = F.substring(F.col("text"), s["start_offset"] + 1, s["end_offset"] - s["start_offset"])
        packed = _pack(body, s["start_offset"], boundary, target)
        whole = lambda c: F.array(F.struct(c["start"].alias("start_offset"),
                                           (c["start"] + c["len"]).alias("end_offset")))
        cuts = F.flatten(F.transform(packed, lambda c: F.when(
            c["tok"] > maximum,
            _windows(F.substring(F.col("text"), c["start"] + 1, c["len"]), c["start"], target, overlap, True))
            .otherwise(whole(c))))
        size = s["end_offset"] - s["start_offset"]
        one = F.filter(F.array(F.struct(s["start_offset"].alias("start_offset"), s["end_offset"].alias("end_offset"))), lambda _: size > 0)
        # No text has more words than characters.
        cuts = F.when(size * F.lit(config.TOKENS_PER_WORD) <= min(target, maximum), one).otherwise(cuts)
        return F.transform(cuts, lambda c: F.struct(
            c["start_offset"].alias("start_offset"), c["end_offset"].alias("end_offset"),
            s["type"].alias("type"), s["weight"].alias("weight")))

    chunked = docs.withColumn("__parts", _all_sections())
    return _chunk_rows(chunked.withColumn("__chunks", F.flatten(F.transform("__parts", cut_section))).drop("__parts"))


def chunk_paragraphs(docs: DataFrame, target: int = config.CHUNK_TARGET_TOKENS,
                     maximum: int = config.CHUNK_MAX_TOKENS, boundary: str = PARAGRAPH_BREAKS) -> DataFrame:
    """Paragraphs, small ones merged."""
    plain = docs.withColumn("sections", F.expr(f"cast(array() as array<{SECTION}>)"))
    return chunk_sections(plain, target, maximum, boundary=boundary)


def chunk_semantic(sentences: DataFrame, least: float) -> DataFrame:
    """A new chunk starts where a sentence's vector is unlike the one before it."""
    from lexigraph.functions.vectors import cosine

    w = Window.partitionBy("doc_id").orderBy("position")
    unlike = F.coalesce((F.round(cosine(F.col("embedding"), F.col("__last")), 6) < least).cast("int"), F.lit(0))
    return (sentences.withColumn("__last", F.lag("embedding").over(w)).withColumn("__new", unlike)
            .withColumn("chunk_index", F.sum("__new").over(w)).drop("__last", "__new"))


def anchored_forms(known: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Each distinct form (``__key``, ``__plain``: its tokens) by its rarest token: ``anchor`` and ``__off``, the tokens before it.

    Rare: few forms have the token (``counts(token, df)``: fewer documents, where such counts are at hand), then long. The choice
    decides how many places are compared, never what is found.
    """
    rest = [c for c in known.columns if c not in ("skill_id", "form")]
    each = known.select(*rest).distinct().select(*rest, F.posexplode("__plain").alias("__off", "anchor"))
    df = counts.select(F.col("token").alias("anchor"), F.col("df").cast("long")) if counts is not None else (
        each.groupBy("anchor").agg(F.count(F.lit(1)).alias("df")))
    least = F.min(F.struct(F.coalesce("df", F.lit(0)), -F.length("anchor"), "anchor", "__off"))
    best = each.join(df, "anchor", "left").groupBy(*[c for c in rest if c != "__plain"]).agg(least.alias("a"), F.first("__plain").alias("__plain"))
    return best.select(*rest, F.col("a.anchor").alias("anchor"), F.col("a.__off").alias("__off"))


def tag_exact(chunks: DataFrame, forms: DataFrame, locale: bool = False, carry: tuple[str, ...] = (),
              counts: DataFrame | None = None, max_rows: int = config.BROADCAST_MAX_ROWS, parts: int | None = None) -> DataFrame:
    """Names and aliases found word for word in the text (doc_id, chunk_index, skill_id, form, position, words).

    Text and ``forms(skill_id, form[, locale])`` go through one tokenizer, so ``C++`` or ``Node.js`` match as they stand; no
    match runs over a sentence mark. Each form waits at its rarest token: one equi-join of the text's tokens with these
    anchors, then the form is compared in place, so neither plan nor rows grow with the longest form. A dictionary
    of up to ``max_rows`` forms is broadcast and the text is not shuffled; a larger one meets the tokens by a shuffle, each with the
    tokens around it. A match inside a longer match is dropped. ``position`` counts tokens, sentence marks included.
    Columns in ``carry`` come along. ``parts``: matches are dealt by document to so many tasks (``text_parts``), so what merges
    them needs no further shuffle; for documents that are one row each before they are chunked.
    """
    keys = ["doc_id", "chunk_index", *(["locale"] if locale else []), *carry]
    more = ["locale"] if locale else []
    plain = F.filter(name_tokens(F.col("form")), lambda t: ~t.rlike(SENTENCE_MARK))
    # The dictionary is tokenised once; all that follows reads the stored rows.
    known = cut(forms.select("skill_id", "form", *more, plain.alias("__plain")).filter("size(__plain) > 0").distinct()
                .withColumns({"__key": F.array_join("__plain", " "), "words": F.size("__plain")}))
    anchors = anchored_forms(known, counts)
    tokens = F.transform(name_tokens(F.col("text")), lambda t: F.when(~t.rlike(SENTENCE_MARK), t)).alias("__tokens")
    at = chunks.select(*keys, tokens).select(*keys, "__tokens", F.posexplode_outer("__tokens").alias("__at", "anchor"))
    first = F.col("__at") - F.col("__off")  # where the match would begin, from 0
    if small := fits(anchors, max_rows):
        at, anchors, begin = at.filter("anchor is not null"), F.broadcast(anchors), first
    else:
        most = known.agg(F.max("words")).first()[0]
        around = F.slice("__tokens", F.greatest(F.col("__at") - F.lit(most - 2), F.lit(1)), F.lit(2 * most - 1))
        at = at.filter("anchor is not null").withColumn("__tokens", around)
        begin = first - F.greatest(F.col("__at") - F.lit(most - 1), F.lit(0))
    same = F.when((begin >= 0) & (begin + F.col("words") <= F.size("__tokens")), F.slice("__tokens", begin + 1, F.col("words")) == F.col("__plain")).otherwise(False)
    hits = at.join(anchors, ["anchor", *more]).filter(same).select(*keys, (first + 1).alias("position"), "__key", "words")
    if parts:
        hits = hits.repartition(parts, "doc_id")
    w = Window.partitionBy("doc_id", "chunk_index").orderBy("position", F.desc("words"))
    before = F.max(F.col("position") + F.col("words")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inside = F.coalesce(before >= F.col("position") + F.col("words"), F.lit(False))
    hits = hits.withColumn("__in", inside).filter("not __in").drop("__in")
    named = known.drop("__plain", "words")
    return hits.join(F.broadcast(named) if small and fits(named, max_rows) else named, ["__key", *more]).drop("__key")


RESULT = ["doc_id", "chunk_index", "skill_id", "confidence", "evidence", "proficiency_hint", "context_type",
          "section_weight", "origin"]


def extract(tags: DataFrame | None = None, shortcuts: DataFrame | None = None,
            responses: DataFrame | None = None) -> DataFrame:
    """Exact tags, near-certain vector matches and ingested model results under one schema.

    All inputs carry doc_id, chunk_index and section_weight of their chunk, so the text is not read again.
    """
    parts = []
    if tags is not None:
        seen = tags.groupBy("doc_id", "chunk_index", "skill_id", "form").agg(
            F.max("section_weight").alias("section_weight"))
        parts.append(seen.groupBy("doc_id", "chunk_index", "skill_id").agg(
            F.array_sort(F.collect_list("form")).alias("evidence"), F.max("section_weight").alias("section_weight"))
            .withColumns({"confidence": F.lit(1.0), "proficiency_hint": F.lit("unknown"),
                          "context_type": F.lit("explicit"), "origin": F.lit("exact")}))
    if shortcuts is not None:
        parts.append(shortcuts.withColumns({
            "evidence": F.expr("cast(array() as array<string>)"), "proficiency_hint": F.lit("unknown"),
            "context_type": F.lit("implicit"), "origin": F.lit("vector")}))
    if responses is not None:
        parts.append(responses.withColumn("origin", F.lit("model")))
    rows = parts[0].select(*RESULT)
    for more in parts[1:]:
        rows = rows.unionByName(more.select(*RESULT))
    return rows


def apply_weighting(results: DataFrame) -> DataFrame:
    """Confidence times the weight of the section."""
    return results.withColumn("confidence", F.col("confidence") * F.coalesce("section_weight", F.lit(1.0)))


def merge_results(results: DataFrame) -> DataFrame:
    """One row per document and concept: best confidence, all evidence, latest proficiency.

    Repeated evidence is dropped before it is collected, so an array is no longer than the distinct strings.
    """
    keys = ["doc_id", "skill_id"]
    per_string = (results.select(*keys, "confidence", F.struct("chunk_index", "proficiency_hint").alias("latest"),
                                 F.explode_outer("evidence").alias("e"))
                  .groupBy(*keys, "e").agg(F.max("confidence").alias("confidence"), F.max("latest").alias("latest")))
    return per_string.groupBy(*keys).agg(
        F.max("confidence").alias("confidence"), F.array_sort(F.collect_list("e")).alias("evidence"),
        F.max("latest").alias("latest")).select(
        *keys, "confidence", "evidence", F.col("latest.proficiency_hint").alias("proficiency_hint"))


def text_parts(docs: DataFrame) -> int:
    """Tasks to deal the documents' matches to: as many as the text asks for, so that the memory of one does not grow with the input."""
    chars = docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // config.TAG_TASK_CHARS))


def extraction_metadata(chunks: DataFrame, results: DataFrame, cached: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """X11: per document the number of chunks, tokens, cache hits, weighted sections and results, and its type if detected."""
    hit = F.coalesce(F.col("__hit"), F.lit(False)) if cached is not None else F.lit(False)
    if cached is not None:
        chunks = chunks.join(cached.select("doc_id", "chunk_index", F.lit(True).alias("__hit")),
                             ["doc_id", "chunk_index"], "left")
    # Chunks of a document were cut from one row; dealt by document once, their sections are counted without a second shuffle.
    used = ["doc_id", "token_estimate", "section", *[c for c in ("__hit", "doc_type") if c in chunks.columns]]
    dealt = chunks.select(*used).repartition(*([parts] if parts else []), "doc_id")
    per_doc = dealt.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks_processed"), F.sum("token_estimate").alias("tokens"),
        F.count_if(hit).alias("cache_hits"), F.count_if(~hit).alias("cache_misses"),
        F.count_distinct("section").alias("sections_detected"),
        *([F.max("doc_type").alias("doc_type")] if "doc_type" in chunks.columns else []))
    found = results.groupBy("doc_id").agg(F.count(F.lit(1)).alias("skills_found"))
    return per_doc.join(found, "doc_id", "left").fillna(0, ["skills_found"])


def extract_documents(docs: DataFrame, forms: DataFrame, skills: DataFrame | None, edges: DataFrame | None, fmt: str = "plain",
                      expand: bool = True, least: float = config.MIN_CONFIDENCE,
                      max_skills: int | None = None, depth: int = config.EXPANSION_DEPTH,
                      max_chars: int | None = config.MAX_TEXT_LENGTH) -> dict[str, DataFrame]:
    """Documents to concepts; the text is read once for the results.

    Documents over a limit are set aside ("failed") and do not stop the others; ``max_chars`` None: texts of any length. Returns the tables skills,
    failed, metadata, chunks and direct (before expansion; the input to co-occurrence). Only expansion reads ``skills`` and ``edges``.
    """
    from lexigraph.operators import filters, graph

    checked = filters.check_limits(docs, max_chars, max_batch=None)
    failed = checked.filter("reason is not null").select("doc_id", "reason")
    good = checked.filter("reason is null").drop("reason")
    marked = detect_sections(clean_documents(good, fmt))
    chunks = chunk_sections(marked)
    parts = text_parts(good)
    raw = extract(tag_exact(whole_sections(marked), forms, carry=("section_weight",), parts=parts))
    # Far smaller than the text, and read by every branch below.
    merged = cut(merge_results(apply_weighting(raw)))
    direct = merged.select("doc_id", "skill_id", "confidence", F.lit(None).cast("string").alias("expansion_type"),
                           F.lit(False).alias("is_expanded"))
    every = direct
    if expand and depth > 0:
        every = every.unionByName(graph.expand(direct, edges, skills, depth))
    kept = filters.min_confidence(every, least)
    if max_skills is not None:
        kept = filters.top_skills(kept, max_skills).drop("rank")
    return {"skills": kept, "failed": failed, "chunks": chunks, "direct": merged,
            "metadata": extraction_metadata(chunks, merged, parts=parts)}
