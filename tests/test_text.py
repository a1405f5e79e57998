import pytest
from pyspark.sql import functions as F

from conftest import rows
from lexigraph import config
from lexigraph.functions import text
from lexigraph.operators import extract, windows


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s"))).first()[0]


def test_cleaning_and_names(spark):
    assert one(spark, "<b>Python</b> and <i>Java</i>", text.clean_html) == "Python and Java"
    page = "<h1>Title</h1><p>One &amp; two</p><ul><li>a</li><li>b</li></ul><script>x()</script>"
    assert one(spark, page, text.clean_html) == "Title\n\nOne & two\n\n- a\n- b"
    assert one(spark, "  <b>bold</b>   name ", text.sanitize) == "bold name"
    assert one(spark, "café", text.sanitize) == one(spark, "café", text.sanitize)
    assert one(spark, "hello world", text.estimate_tokens) == 3
    assert one(spark, "", text.estimate_tokens) == 0


def test_slugs(spark):
    names = [("1", "Machine Learning"), ("2", "Café Brewing"), ("3", "C++"), ("4", "Python"), ("5", "Python"),
             ("6", "x" * 150)]
    new = spark.createDataFrame(names, "id string, name string")
    old = spark.createDataFrame([("machine-learning",)], "slug string")
    got = dict(rows(windows.unique_slugs(new, old), "id", "slug"))
    assert got["1"] == "machine-learning-2" and got["2"] == "cafe-brewing" and got["3"] == "c-plus-plus"
    assert {got["4"], got["5"]} == {"python", "python-2"} and len(got["6"]) == config.SLUG_MAX_LENGTH


JD = "Intro line\n\nRequirements\nPython and SQL.\n\nNice to have:\nDocker.\n\n# About us\nWe sell tea.\n\nBenefits\nFruit."
CV = "Skills\nPython\n\nExperience\nBuilt things\n\nProjects\nA site\n\nEducation\nBSc\n\nSummary\nKeen."


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_sections_and_weights(spark):
    d = extract.detect_sections(docs(spark, JD, CV, "plain text without headings", ""))
    assert rows(d, "doc_id", "doc_type") == [(0, "jd"), (1, "cv"), (2, "generic"), (3, "generic")]
    got = extract.explode_sections(d).filter("doc_id = 0").orderBy("start_offset").collect()
    assert [(r.section_type, r.weight) for r in got] == [
        ("requirements", 1.0), ("nice_to_have", 0.75), ("company", 0.5), ("benefits", 0.3)]
    assert JD[got[0].start_offset:got[0].end_offset].startswith("Requirements\nPython")
    cv = {r.section_type: r.weight for r in extract.explode_sections(d).filter("doc_id = 1").collect()}
    assert cv == {"skills": 1.0, "experience": 0.9, "projects": 0.85, "education": 0.8, "summary": 0.7}


def test_chunks_cover_the_text(spark):
    long = "\n\n".join(" ".join(f"w{p}x{i}." for i in range(90)) for p in range(40))
    d = docs(spark, JD, CV, "", "short", long)
    chunks = extract.chunk_sections(extract.detect_sections(d), target=300, maximum=400, overlap=40)
    by_doc = {}
    for r in chunks.orderBy("doc_id", "chunk_index").collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    assert 2 not in by_doc and len(by_doc[3]) == 1 and len(by_doc[1]) == 5
    for doc, text_ in ((0, JD), (1, CV), (4, long)):
        assert "".join(r.text for r in by_doc[doc]) == text_
        assert all(text_[r.start_offset:r.end_offset] == r.text for r in by_doc[doc])
    assert all(r.token_estimate <= 400 for r in by_doc[4]) and len(by_doc[4]) == 20  # two paragraphs of 117 tokens each


def test_sliding_windows(spark):
    words = [f"w{i}" + ("." if i % 10 == 9 else "") for i in range(3076)]
    text_ = " ".join(words)
    chunks = extract.chunk_sliding(docs(spark, text_)).orderBy("chunk_index").collect()
    assert len(chunks) == 3
    assert chunks[0].start_offset == 0 and chunks[-1].end_offset == len(text_)
    for a, b in zip(chunks, chunks[1:]):
        assert b.start_offset <= a.end_offset and a.text.rstrip().endswith(".")
    assert all(text_[c.start_offset:c.end_offset] == c.text for c in chunks)
    # One unbroken oversize paragraph falls back to windows.
    d = extract.detect_sections(docs(spark, text_))
    assert extract.chunk_sections(d).count() == 3


def test_longest_tag_wins(spark):
    forms = spark.createDataFrame([("ml", "machine learning"), ("m", "machine"), ("l", "learning"), ("py", "python")],
                                  "skill_id string, form string")
    chunks = docs(spark, "Machine learning, Python; a machine.").withColumn("chunk_index", F.lit(0))
    got = rows(extract.tag_exact(chunks, forms), "position", "skill_id")
    assert got == [(1, "ml"), (3, "py"), (5, "m")]


def test_names_with_punctuation_and_long_forms(spark):
    forms = spark.createDataFrame([(f, f) for f in ("C++", "Node.js", ".NET", "Expert", "C#", "java script", "site reliability engineering lead", "C")],
                                  "skill_id string, form string")
    text_ = "Expert in C++, Node.js and .NET. C# too; we write java. Script by a Site Reliability Engineering Lead."
    got = {r.skill_id for r in extract.tag_exact(docs(spark, text_).withColumn("chunk_index", F.lit(0)), forms).collect()}
    assert got == {"C++", "Node.js", ".NET", "Expert", "C#", "site reliability engineering lead"}


def test_slugs_of_other_scripts(spark):
    names = ["Tiếng Việt", "Łódź", "Straße", "日本語", "C++", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(text.slug(F.col("n"))).collect()]
    assert got == ["tieng-viet", "lodz", "strasse", "", "c-plus-plus", None]


def test_merge_results(spark):
    r = spark.createDataFrame([(1, 0, "s", 0.8, ["a"], "beginner"), (1, 1, "s", 0.9, ["b", "a"], "expert"),
                               (1, 0, "t", 0.5, [], "unknown")],
                              "doc_id int, chunk_index int, skill_id string, confidence double, "
                              "evidence array<string>, proficiency_hint string")
    got = {x.skill_id: x for x in extract.merge_results(r).collect()}
    assert got["s"].confidence == 0.9 and got["s"].evidence == ["a", "b"] and got["s"].proficiency_hint == "expert"
    assert got["t"].evidence == []
    assert extract.merge_results(r.limit(0)).count() == 0


def test_full_job(spark, make_edges, make_skills):
    forms = spark.createDataFrame([("py", "python"), ("doc", "docker"), ("tea", "tea")], "skill_id string, form string")
    d = docs(spark, JD, "", "x" * 100_001).withColumn("source", F.lit("s"))
    edges = make_edges([("lang", "py"), ("lang", "java")])
    out = extract.extract_documents(d, forms, make_skills(["py", "doc", "tea", "lang", "java"]), edges)
    got = {r.skill_id: (round(r.confidence, 4), r.expansion_type) for r in out["skills"].collect()}
    assert got == {"py": (1.0, None), "doc": (0.75, None), "tea": (0.5, None), "lang": (0.6, "parent"),
                   "java": (0.6, "sibling")}
    assert rows(out["failed"]) == [(1, "text is empty"), (2, "text is too long")]


def test_text_length_is_limited_or_not(spark, make_skills, make_edges):
    d = spark.createDataFrame([("long", "filler " * 20_000 + "python"), ("short", "python")], "doc_id string, text string").withColumn("source", F.lit("generic"))
    forms = spark.createDataFrame([("py", "python")], "skill_id string, form string")
    got = {}
    for most in (config.MAX_TEXT_LENGTH, None):
        out = extract.extract_documents(d, forms, make_skills(["py"]), make_edges([]), expand=False, max_chars=most)
        got[most] = rows(out["skills"], "doc_id", "skill_id"), rows(out["failed"], "doc_id")
    assert got == {config.MAX_TEXT_LENGTH: ([("short", "py")], [("long",)]), None: ([("long", "py"), ("short", "py")], [])}


@pytest.mark.parametrize("way", ["broadcast", "shuffle", "counts"])
def test_anchored_forms_match_brute_force(spark, way):
    """Forms of 1 to 60 words at their rarest token, found by either join; forms that share tokens, keys or places; sentence marks."""
    import random

    import regex

    rng = random.Random(4)
    words = ["a", "b", "c", "C++", "node.js", "d", "."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["", None, "x " * 50 + " ".join(f"w{k}" for k in range(60)) + " . b a"]
    forms = [(f"s{k}", " ".join(rng.choice(words[:-1]) for _ in range(rng.randint(1, 5)))) for k in range(25)]
    forms += [("long", " ".join(f"W{k}" for k in range(60))), ("up", "NODE.JS"), ("up2", "node.js"), ("none", "..."), ("part", "w3 w4"), ("cross", "b. a")]
    tokens = lambda s: regex.findall(r"\.?[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*[+#]*|[.!?]+", (s or "").lower())
    mark = lambda t: regex.fullmatch(r"[.!?]+", t) is not None
    want = set()
    for i, text in enumerate(texts):
        t, hits = tokens(text), {}
        for skill, form in forms:
            plain = [x for x in tokens(form) if not mark(x)]
            for p in range(len(t) - len(plain) + 1):
                if plain and t[p:p + len(plain)] == plain:
                    hits.setdefault((p + 1, len(plain)), set()).add((skill, form))
        reach = 0
        for p, n in sorted(hits, key=lambda h: (h[0], -h[1])):
            if reach < p + n:
                want |= {(i, s, f, p, n) for s, f in hits[p, n]}
            reach = max(reach, p + n)
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id int, chunk_index int, text string")
    counts = spark.createDataFrame([(w.lower(), k) for k, w in enumerate(words)], "token string, df int") if way == "counts" else None
    got = extract.tag_exact(chunks, spark.createDataFrame(forms, "skill_id string, form string"), counts=counts, max_rows=3 if way == "shuffle" else 1000)
    assert sorted(map(tuple, got.select("doc_id", "skill_id", "form", "position", "words").collect())) == sorted(want) and len(want) > 100


def test_plan_does_not_follow_the_longest_form(spark):
    chunks = spark.createDataFrame([(1, 0, "a b c")], "doc_id int, chunk_index int, text string")
    sizes = []
    for n in (2, 60):
        forms = spark.createDataFrame([("s", " ".join(f"w{k}" for k in range(n))), ("t", "a b")], "skill_id string, form string")
        plan = extract.tag_exact(chunks, forms)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
    assert abs(sizes[1] - sizes[0]) < 200


def shuffles_of_documents(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(doc_id#")


def test_results_of_whole_documents_are_shuffled_once(spark):
    """Tags, evidence and merged results of a document stay where its matches were dealt."""
    chunks = extract.chunk_sections(extract.detect_sections(docs(spark, JD, CV)))
    forms = spark.createDataFrame([("K:python", "python"), ("K:sql", "sql")], "skill_id string, form string")
    merged = {}
    for parts in (None, 3):
        tags = extract.tag_exact(chunks, forms, carry=("section_weight",), parts=parts)
        merged[parts] = extract.merge_results(extract.apply_weighting(extract.extract(tags)))
    assert shuffles_of_documents(merged[3]) == 1 < shuffles_of_documents(merged[None])  # before they run: then the plan stands there twice
    assert rows(merged[3]) == rows(merged[None]) and len(rows(merged[3], "doc_id")) == 3


def test_matches_are_dealt_to_more_tasks_for_more_text(spark, monkeypatch):
    monkeypatch.setattr(config, "TAG_TASK_CHARS", 10)
    assert extract.text_parts(docs(spark, "x" * 200, "y" * 5, None)) == 21
    assert extract.text_parts(docs(spark, "x").limit(0)) == spark.sparkContext.defaultParallelism


def test_metadata_shuffles_chunks_once_and_needs_no_graph(spark):
    out = extract.extract_documents(
        docs(spark, JD, CV), spark.createDataFrame([("K:python", "python")], "skill_id string, form string"), None, None, expand=False)
    assert rows(out["metadata"], "doc_id", "chunks_processed", "sections_detected", "skills_found") == [(0, 5, 4, 1), (1, 5, 5, 1)]
    chunks = out["chunks"].withColumn("doc_type", F.lit("jd"))
    none = spark.createDataFrame([], "doc_id int")
    assert shuffles_of_documents(extract.extraction_metadata(chunks, none.hint("broadcast"))) <= 2


def test_short_sections_are_cut_as_long_ones_are(spark):
    """The bound on characters decides only what the count of words would decide too."""
    body = "a b\n\nc d\n\n" + "e " * 40
    for text in (body, "a", "a" * 77, "word " * 30):
        one = docs(spark, text)
        short = extract.chunk_sections(extract.detect_sections(one), target=100, maximum=200)
        pieces = one.withColumn("c", F.expr("1")).select(extract._pack(F.col("text"), F.lit(0), extract.STRUCTURAL_BREAKS, 100).alias("p")).first().p
        assert rows(short, "start_offset", "end_offset") == [(p.start, p.start + p.len) for p in pieces]
