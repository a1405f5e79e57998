from pyspark.sql import functions as F

from conftest import rows
from lexigraph.operators import extract
from lexigraph.plans.scale import work_dir
from lexigraph.streaming import jobs


def arrive(spark, folder, data, schema, n):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def test_signal_state_spans_batches_and_resets_after_a_gap(spark):
    folder, path, schema = work_dir(spark, "in"), work_dir(spark, "t2"), "normalized_form string, ts_us bigint"
    source = lambda: jobs.file_stream(spark, folder, spark.createDataFrame([], schema).schema)
    for n, batch in enumerate(([("a", 1), ("a", 2), ("a", 3)], [("a", 4), ("a", 5), ("b", 5)],
                               [("a", 5000), ("b", 6), ("b", 7), ("b", 8), ("b", 9)])):
        arrive(spark, folder, batch, schema, n)
        jobs.finish(jobs.stream_signals(source(), path, 5, 1000))
    assert rows(jobs.output(spark, path), "normalized_form", "triggers") == [("a", 1), ("b", 1)]


def test_signal_state_expires_by_event_time(spark):
    """A replay: the state of a form goes a gap after its last signal, and rows behind the watermark do not count."""
    folder, path, schema = work_dir(spark, "in"), work_dir(spark, "t2"), "normalized_form string, ts_us bigint"
    day, source = 86_400_000_000, jobs.file_stream
    held = []
    for n, batch in enumerate(([("x", day)] * 3, [("y", 33 * day)] * 3, [("y", 20 * day)] * 2 + [("x", 33 * day + i) for i in range(5)])):
        arrive(spark, folder, batch, schema, n)
        query = jobs.stream_signals(source(spark, folder, spark.createDataFrame([], schema).schema), path, 5, 30 * day)
        jobs.finish(query)
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held == [1, 1, 2]  # x goes with the second file (rows of 1970-01-01 would lie at the first watermark)
    assert rows(jobs.output(spark, path), "normalized_form", "triggers") == [("x", 1)]


def test_poison_rows_end_in_the_dead_letters(spark):
    folder, path, schema = work_dir(spark, "in"), work_dir(spark, "t7"), "id int, good boolean"
    handler = lambda df: df.withColumn("ok", F.col("good"))
    for n in range(4):
        arrive(spark, folder, [(n, n != 0)], schema, n)
        jobs.finish(jobs.with_dead_letter(
            jobs.file_stream(spark, folder, spark.createDataFrame([], schema).schema), path, handler))
    assert rows(jobs.output(spark, path, "ok"), "id") == [(1,), (2,), (3,)]
    assert rows(jobs.output(spark, path, "dead"), "id", "attempts") == [(0, 3)]


def test_search_documents_follow_the_tables(spark):
    """After every batch the sink equals the documents made from the tables; untouched buckets keep their files."""
    from lexigraph.sources import exchange

    skill = "id string, external_id string, canonical_name string, slug string, description string, category string, status string"
    state = {f"s{i:02d}": "active" for i in range(40)}
    forms = {(s, f"{s} form") for s in state}

    def tables():
        skills = spark.createDataFrame([(i, i, i, i, None, "tool", st) for i, st in state.items()], skill)
        return exchange.search_documents(skills, spark.createDataFrame(sorted(forms), "skill_id string, surface_form string"))

    def flat(df):
        return sorted((r.id, r.canonical_name, r.page, tuple(r.aliases or ())) for r in df.collect())

    path, log = work_dir(spark, "t4"), "entity_id string, graph_version bigint, mutation_type string"
    jobs.load_search_documents(tables(), path, version=10, buckets=8)
    assert flat(jobs.read_search_documents(spark, path)) == flat(tables())
    batches = [
        ({"s01": "deprecated", "new": "active"}, {("new", "a"), ("s02", "b")},
         [("s01", 11, "skill_deprecated"), ("new", 12, "skill_created"), ("s02", 13, "alias_added")]),
        ({}, set(), []),
        ({"s03": "merged"}, {("s04", "c")},
         [("s03", 21, "skill_merged"), ("s04", 22, "alias_added"), ("s01", 5, "skill_updated"), ("s02", 9, "skill_deprecated")]),
        ({"s01": "active", "s05": "deprecated"}, set(), [("s01", 31, "skill_updated"), ("s05", 32, "skill_updated")]),
    ]
    for n, (changed, added, entries) in enumerate(batches):
        before = {r.bucket: r.version for r in jobs._published(spark, path, n - 1).collect()}
        state |= changed
        forms |= added
        batch = spark.createDataFrame(entries, log)
        for _ in range(2 if n == 2 else 1):  # a batch that is run again changes nothing
            jobs.apply_search_changes(batch, n, tables, path)
        assert flat(jobs.read_search_documents(spark, path)) == flat(tables())
        after = {r.bucket: r.version for r in jobs._published(spark, path, n).collect()}
        assert len(after) == 8 and sum(v == n for v in after.values()) <= len(entries)
        assert all(v in (n, before[b]) for b, v in after.items())


def test_arrivals_are_files_of_bounded_size(spark, monkeypatch):
    """A slice of events, or a share of the rows, was one file read by one task."""
    from lexigraph.plans import stream_queries as sq
    from lexigraph.sources.derived import Derived

    d = Derived(spark, "/root/testdata/sf0.001")
    ids = spark.range(0, 1000, 1, 8)
    stream = sq._spread(d, ids, 2)
    done = []
    size = (F.count_distinct("file"), F.count(F.lit(1)))
    jobs.finish(jobs.start(stream.withColumn("file", F.input_file_name()), sq.work_dir(spark, "spread"),
                           lambda b, n: done.append(tuple(b.agg(*size).first()))))
    assert [f for f, _ in done] == [4, 4] and sum(n for _, n in done) == 1000

    def arrived():
        seen, path = [], sq.work_dir(spark, "turns")
        sq._in_turn(d, lambda s: jobs.start(s.raw("events").withColumn("file", F.input_file_name()), path,
                                           lambda b, n: seen.append(tuple(b.agg(*size).first()))))
        return seen

    whole = arrived()
    monkeypatch.setattr(sq, "ARRIVING_ROWS", whole[0][1] // 4)
    cut = arrived()
    assert [n for _, n in cut] == [n for _, n in whole] and all(a == 1 for a, _ in whole) and all(b >= 4 for b, _ in cut)


def test_names_at_the_edge_of_a_chunk_are_found_whole(spark):
    """Chunks of a long text begin and end at words 1,000 and 1,153: a name there is neither lost nor found in parts."""
    forms = spark.createDataFrame([(f, f) for f in ("alpha beta gamma", "alpha beta", "alpha", "beta")], "skill_id string, form string")
    ahead = [*range(996, 1002), *range(1149, 1155)]
    texts = [(n, " ".join(["lorem"] * n + ["Alpha", "Beta", "Gamma"] + ["ipsum"] * 400), "en", "web") for n in ahead]
    texts += [(-n, "lorem " * 1500 + "Alpha\n\nBeta" + " ipsum" * n, "en", "web") for n in (5, 800)]
    folder, path, schema = work_dir(spark, "in"), work_dir(spark, "t1"), "doc_id int, text string, locale string, source string"
    arrive(spark, folder, texts, schema, 0)
    docs = spark.read.parquet(folder)
    jobs.finish(jobs.stream_extract(jobs.file_stream(spark, folder, docs.schema), forms, path))
    want = sorted([(n, "alpha beta gamma") for n in ahead] + [(-n, "alpha beta") for n in (5, 800)])
    assert rows(jobs.output(spark, path), "doc_id", "skill_id") == want
    got = extract.extract_documents(docs, forms, None, None, expand=False, max_chars=None)["skills"]
    assert rows(got, "doc_id", "skill_id") == want
