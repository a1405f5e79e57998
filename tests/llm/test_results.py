"""Operators against brute force, exact round trips or held-out labels on the smallest tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from lexigraph.llm import decontaminate, html_extract, langid, linededup, minhash, packing, prefix_free, quality, queries, sharding, toxicity, vec

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def brute_repeats(texts, width=100):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            s = b[p:p + width]
            if s in seen:
                gone[p:p + width] = b"\1" * width
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_brute_force(spark, texts):
    got = {r[0]: tuple(r)[1:] for r in queries.op3_suffix_dedup(spark, FOLDER).collect()}
    assert got == brute_repeats(texts)


def test_repeats_in_crowds(spark, monkeypatch):
    """Self-overlapping texts, one passage in very many places (several suffix arrays a trigger), blocks of long texts."""
    monkeypatch.setattr(prefix_free, "PART", 4)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = word(120)
    texts = {i: word(int(rng.integers(0, 90))) + passage + word(int(rng.integers(0, 90))) for i in range(60)}
    texts |= {100: "a" * 400, 101: "ab" * 300, 102: word(50) * 9, 103: "", 104: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r[0]: tuple(r)[1:] for r in prefix_free.remove_repeats(df).collect()} == brute_repeats(texts)


def test_rolling_minimum_and_hashes():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1000, 500, dtype=np.uint64)
    for span in (1, 7, 69):
        assert (prefix_free._least(x, span) == [x[i:i + span].min() for i in range(len(x) - span + 1)]).all()
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    data[700:900] = data[100:300]
    h = vec.rolling(data, 100)
    assert h[100] == h[700] and len(np.unique(h)) == len(h) - 101


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts, percent=85):
    s = {i: sets(t) for i, t in texts.items()}
    part = {i: i for i in s}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in itertools.combinations(sorted(s), 2):
        both = len(s[a] & s[b])
        if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            x, y = sorted((root(a), root(b)))
            part[y] = x
    return {i: (len(s[i]), root(i), root(i) == i) for i in s}


def test_near_duplicates_against_brute_force(spark, texts):
    got = {r[0]: tuple(r)[1:] for r in queries.op7_minhash(spark, FOLDER).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_in_wide_buckets(spark, monkeypatch):
    """Many texts around one centre at similarities near the threshold, with buckets cut into many tiles."""
    monkeypatch.setattr(minhash, "TILE", 2_000)
    rng = np.random.default_rng(4)
    texts, n = {}, 0
    base = [f"w{i}" for i in range(120)]
    for _ in range(90):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(1, 7)), replace=False):
            w[k] = f"x{rng.integers(0, 10_000)}"
        texts[n] = " ".join(w)
        n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(df).collect()} == brute_components(texts)


def test_near_dedup_stage_links_from_80_percent(spark):
    """Pairs of 100 shingles with two changed words (0.818) or three (0.739)."""
    rows = []
    for i in range(20):
        w = [f"t{i}w{k}" for k in range(104)]
        other = [f"new{k}" if k in ((20, 60) if i < 10 else (20, 50, 80)) else x for k, x in enumerate(w)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    assert 0.8 <= len(sets(rows[0][1]) & sets(rows[1][1])) / len(sets(rows[0][1]) | sets(rows[1][1])) < 0.85
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, FOLDER).collect()}
    assert kept == {i for i, v in brute_components(dict(rows), 80).items() if v[2]} == set(range(0, 20, 2)) | set(range(20, 40))


def test_line_chunks_resist_shifts(spark):
    lines = [f"line number {i} of a passage" for i in range(60)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["new first line", *lines]))], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in linededup.report(df).collect()}
    assert removed[1] == 0 and removed[2] >= 50


def brute_passages(texts):
    """Every two neighbouring lines with a word, and every line of over 50 words, by their bytes."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        lines = t.split("\n") if t else []
        real = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        spans = list(itertools.pairwise(real)) + [(k, k) for k in real if len(re.findall(r"[^\x20\x09-\x0D]+", lines[k])) > 50]
        gone = set()
        for a, b in sorted(spans):
            s = "\n".join(lines[a:b + 1])
            if s in seen:
                gone |= set(range(a, b + 1))
            seen.add(s)
        out[i] = (len(lines), len(gone), hashlib.sha256("\n".join(x for k, x in enumerate(lines) if k not in gone).encode()).hexdigest())
    return out


def test_repeated_passages_against_brute_force(spark, texts):
    assert {r[0]: tuple(r)[1:] for r in queries.op5_line_dedup(spark, FOLDER).collect()} == brute_passages(texts)


def test_passages_of_few_lines_go_in_any_host(spark):
    """Passages of 1 to 8 lines in hosts of their own lines; a short line alone, and the first place of each, stay."""
    line = lambda *at: " ".join(f"w{k}-" + "-".join(map(str, at)) for k in range(60))
    rows, want = [], {}
    for n in range(1, 9):
        passage = [line("passage", n, k) for k in range(n)]
        for host in range(12):
            before, after = ([line("host", n, host, side, k) for k in range(1 + host % 4)] for side in (0, 1))
            rows.append((100 * n + host, "\n".join([*before, "short", "", *passage, *after])))
            want[100 * n + host] = n if host else 0
    rows += [(1, ""), (2, None), (3, "\n\n"), (4, "a\na\na"), (5, "b\n\nc\n"), (6, "x\nb\n\nc\n")]
    want |= {1: 0, 2: 0, 3: 0, 4: 2, 5: 0, 6: 3}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in linededup.report(df).collect()}
    pair = {i for i, t in rows if i >= 100 and i % 100}  # each "short" with its first passage line is a repeated pair
    assert {i: v[1] - 2 * (i in pair) for i, v in got.items()} == want and got == brute_passages(dict(rows))


def test_templates_find_other_numbers_and_names(spark):
    item = "Yesterday in Paris our friend Alice bought 12 apples and gave 5 kg of them to her neighbour Bob before noon."
    same = "Yesterday in Rome our friend Carol bought 30 apples and gave 7 lb of them to her neighbour Dave before noon."
    far = "Yesterday nobody in town bought apples, and the neighbours of our friend gave nothing to anyone before noon."
    df = spark.createDataFrame([(1, f"Some text first. {same} And more."), (2, far), (3, item.lower())], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r["doc_id"], r["contaminated"]) for r in decontaminate.flag(df, items).orderBy("doc_id").collect()][:2] == [(1, True), (2, False)]
    loop = "If 3 boys have 3 dogs and 3 dogs eat 3 bones then 3 boys buy 3 bones for 3 dogs."
    mixed = "If 4 boys have 5 dogs and 6 dogs eat 7 bones then 8 boys buy 9 bones for 2 dogs."
    df = spark.createDataFrame([(1, loop.replace("3", "8")), (2, mixed)], "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.flag(df, spark.createDataFrame([(1, loop)], "item_id long, text string")).collect()}
    assert got == {1: True, 2: False}  # one value for one value, or no match


def test_decontamination_finds_verbatim_passages(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    want = {i for i, t in texts.items() if any(flat(x) in flat(t) for x in items.values())}
    got = {r["doc_id"] for r in queries.op4_decontamination(spark, FOLDER).collect() if r["contaminated"]}
    assert got == want


def test_decontamination_finds_verbatim_items_full_of_slots(spark):
    """Numbers, Title Case, upper case, lists of names and items of two or three tokens: copies are found, other fillings are not."""
    items = {1: "Compute 17 + 25 - 9 + 3", 2: "The Rise And Fall Of The Third Roman Empire In Ten Long Acts", 3: "NAME ALL THE RIVERS THAT FLOW INTO THE BLACK SEA",
             4: "Paris, Rome, Madrid, Berlin, Vienna, Lisbon, Dublin, Warsaw, Athens, Prague", 5: "Evaluate 81 / 9", 6: "Solve 1234567"}
    others = {1: "Compute 18 + 26 - 8 + 4", 2: "The Song And Tale Of The Last Greek Kingdom In Six Short Parts", 3: "LIST ALL THE CITIES THAT STAND BESIDE THE WHITE LAKE",
              4: "Oslo, Bern, Minsk, Kyiv, Riga, Sofia, Tunis, Cairo, Accra, Lima", 5: "Evaluate 82 / 8", 6: "Solve 7654321"}
    rows = [(k, f"Some words before it: {x}. And more words.") for k, x in items.items()] + [(10 + k, f"we first say {x}") for k, x in items.items()]
    rows += [(20 + k, f"Some words before it: {x}. And more words.") for k, x in others.items()] + [(30 + k, x) for k, x in others.items()]
    flagged = decontaminate.flag(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {r["doc_id"]: r["item_ids"] for r in flagged.collect()}
    assert got == {i: [i % 10] if i < 20 else [] for i, _ in rows}


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        guess, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            n, at = (n + 1, s) if at + s > guess else (n, at + s)
        low, high = (low, guess) if n <= shards else (guess + 1, high)
    return low


@pytest.mark.parametrize("seed", range(3))
def test_capacity_is_the_smallest(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "MARKS", 16)
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.choice([1, 2, 7, 500, 999], int(rng.integers(1, 300)))]
    if seed == 2:
        sizes[len(sizes) // 2] = sum(sizes)
    ends = list(itertools.accumulate(sizes))
    found, cuts = sharding.capacity_and_cuts(spark.createDataFrame([(e,) for e in ends], "end long").cache(), ends[-1], max(sizes))
    assert found == least_capacity(sizes, 16) and cuts[-1] == ends[-1]
    assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) <= found


def test_shards(spark, texts):
    got = queries.op6_sharding(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    place = {r["doc_id"]: r["shard"] for r in got}
    groups = collections.defaultdict(list)
    for i, t in sorted(texts.items()):
        groups[t].append(i)
    assert all(len({place[i] for i in g}) == 1 for g in groups.values())
    loads = collections.Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) <= least_capacity([sum(len(t.encode()) + 1 for _ in g) for t, g in groups.items()], 16)


def test_packing_round_trip(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = collections.defaultdict(list)
    got = queries.op8_best_fit_packing(spark, FOLDER).collect()
    for r in got:
        rows[r["doc_id"]].append(r)
    for i, text in texts.items():
        ids, at = [*t.encode(text, add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(rows[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == 1024 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 1024
    assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 1024 + 1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ranks_give_the_tokenizers_ids(text):
    t = test_ranks_give_the_tokenizers_ids.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert list(packing.encoder(RANKS).encode(text, allowed_special="all")) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n", "a", " \n"])
def test_long_runs_give_the_tokenizers_ids(spark, run):
    text = "x" + run * 1_200_000 + "y"
    want = np.array([*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 2], "<u4")
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), RANKS).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == len(want) and {r["doc_id"] for r in rows} == {1, 2}
    assert all(r["ids_crc32"] == zlib.crc32(want[r["start"]:r["start"] + r["length"]].tobytes()) for r in rows if r["doc_id"] == 1)


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    patterns = packing.plan(histogram, cap=64, groups=6)
    used = collections.Counter()
    for items, n in patterns:
        assert sum(items) <= 64 and n > 0
        for x in items:
            used[x] += n
    assert used == collections.Counter(histogram)
    bound = -(-sum(k * v for k, v in histogram.items()) // 64)
    assert sum(n for _, n in patterns) <= 1.25 * max(bound, sum(v for k, v in histogram.items() if k > 32)) + 2


def test_quality_measures_against_brute_force(spark, texts):
    for r in queries.op9_quality_rules(spark, FOLDER).collect():
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        repeated = {k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated))
        assert tuple(r[m] for m in quality.MEASURES[:5]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])


def test_estimated_accuracies_part_good_from_bad():
    good, bad = "g" * 8, "ggbggggb"
    post = quality.fit({good: 900, bad: 40, "ggbgbgg-": 40, "bggggggg": 20})
    assert post[good] > 0.99 and post[bad] < 0.1 and post["bggggggg"] > 0.5
    assert quality.fit({}) == {}


def test_quality_agrees_with_labels(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality").withColumnRenamed("quality", "label")
    rows = queries.op9_quality_rules(spark, FOLDER).join(labels, "doc_id").filter("label is not null and not base_failed").collect()
    assert sum(r["kept"] == bool(r["label"]) for r in rows) >= 0.95 * len(rows)


def test_grammar():
    g = toxicity.Grammar({"veju": 0.9})
    plain, negated, told = (g.score(s)[0] for s in ("You are an idiot.", "You are not an idiot.", 'He said "you are an idiot" again.'))
    assert plain >= 0.7 > told > negated > 0
    assert g.score("I will kill you.")[0] >= 0.7 and g.score("This will kill the process.")[0] == 0
    assert g.score("un vejuaire, a moron. And scum!")[0] > g.score("a vejuaire")[0] >= 0.7


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    rows = queries.op1_toxicity(spark, folder).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = queries.op2_language_id(spark, folder).filter("held_out").join(lang, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_spans_of_mixed_text(spark, docs):
    model = langid.learn(docs)
    one = {r["lang"]: r["text"] for r in docs.filter("n_chars > 1500").select("lang", "text").collect()}
    mixed = spark.createDataFrame([(1, one["en"][:900] + "\n" + one["fr"][:900])], "doc_id long, text string")
    spans = langid.spans(mixed, model).orderBy("span").collect()
    assert spans[0]["lang"] == "en" and spans[-1]["lang"] == "fr" and len(spans) <= 4


def brute_viterbi(scores, penalty):
    best, back = scores[0].copy(), []
    for s in scores[1:]:
        move = np.where(np.arange(len(best))[:, None] == np.arange(len(best)), best[:, None], best[:, None] - penalty)
        back.append(move.argmax(0))
        best = move.max(0) + s
    return best.max()


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    counts = [0, 5, 1, 40]
    first = np.concatenate(([0], np.cumsum(counts)))
    scores = rng.normal(0, 3, (first[-1], 3)).astype(np.float32)
    label = langid._viterbi(scores, first, 4.0)
    for a, b in itertools.pairwise(first):
        if b > a:
            path = label[a:b].astype(int)
            value = scores[np.arange(a, b), path].sum() - 4.0 * (path[1:] != path[:-1]).sum()
            assert abs(value - brute_viterbi(scores[a:b].astype(float), 4.0)) < 1e-2


@pytest.mark.parametrize("source,text", [
    ("<nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>One, two.<p>Three&nbsp;<b>fo</b>ur.</article><footer>x</footer>", "Title & more One, two. Three four."),
    ("<div class=menu>Menu, here</div><div id=c><p>First para, with words.</p><p>Second para.</p><ul><li>item</li></ul></div>"
     "<div class='comments'><p>Nice post, friend. Wow, such.</p></div><form>sign, up</form>", "First para, with words. Second para. item"),
    ("<script>var a='<p>no</p>'</script><p>yes<br>line</p>", "yes line"),
    ("<p>a <!-- <p>hidden --> b</p>", "a b"),
    ("<main><p>Text, one.</p><div class=ad>Buy, now!</div><aside>Side</aside><p>Text two.</p></main>", "Text, one. Text two."),
    ("no markup, at all", "no markup, at all"), ("", ""), (None, ""),
])
def test_main_text(source, text):
    assert html_extract.main_text(source) == text


def test_articles_of_the_pages(spark):
    import html

    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in queries.op10_html_extraction(spark, FOLDER).collect():
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article[1])).split()) and r["n_chars"] == len(r["text"])


def test_pipeline_against_its_parts(spark, docs, texts):
    """The stages composed by brute force where there is one: what each keeps decides what the next one sees."""
    kept = {r["doc_id"]: r["text"] for r in quality.keep(docs).collect()}
    judged = {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    assert set(kept) == judged
    lines = brute_passages(kept)
    shorter = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs.filter(docs.doc_id.isin(list(kept))), FOLDER).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in shorter.items()} == {i: v[2] for i, v in lines.items()}
    unique = {i for i, v in brute_components(shorter, 80).items() if v[2]}
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    left = {i for i in unique if not any(flat(x) in flat(shorter[i]) for x in items)}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()} == left


def test_chunks_carry_long_passages():
    """Chunks are cut by their lines alone, so that a passage's inner chunks are the same in any host and form one run."""
    line = lambda k: f"line {k} of some passage".encode()
    passage = [line(k) for k in range(40)]

    def spans(rows):
        data = np.frombuffer(b"\n".join(rows), np.uint8)
        row, start, end, words, _ = linededup.lines(data, np.array([0, len(data)]))
        h = vec.Prefix(data, vec.BASE1, vec.TABLE1).of(start, end)
        return {(int(a), int(b)) for a, b in zip(*linededup.chunks(h, row, np.flatnonzero(words > 0)), strict=True)}

    one, two = spans([b"host one", *passage]), spans([b"other", b"host", b"", *passage, b"end"])
    shared = {(a - 1, b - 1) for a, b in one} & {(a - 3, b - 3) for a, b in two}
    assert len(shared) >= 3 and len(one) - len(shared) <= 2
    found = [{"line": a, "n": b - a + 1, "kind": linededup.CHUNK, "fd": 7, "fl": a + 2} for a, b in one]
    found += [{"line": k, "n": 2, "kind": linededup.PAIR, "fd": 7, "fl": k + 2} for k in range(1, 40)] + [{"line": 50, "n": 2, "kind": linededup.PAIR, "fd": 3, "fl": 0}]
    assert sorted(linededup.grow(found)) == [(1, 40, 7, 3), (50, 2, 3, 0)]


@settings(max_examples=12, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c d", "", " ", "e", "f g h", "i"]), max_size=12), min_size=1, max_size=12))
def test_small_line_texts_against_brute_force(spark, texts):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    got = linededup.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute_passages(dict(rows))


def test_inner_names_do_not_clash(spark):
    """Columns of any name pass through ``line_dedup`` unchanged."""
    names = ["id", "gone", "_gone", "shortened", "lines", "Removed", "line", "n", "fd", "want", "__text", "__id", "__removed"]
    df = spark.createDataFrame([(k, "same one\nsame two\nsame three", *[f"{n}{k}" for n in names]) for k in range(2)], ["doc_id", "text", *names])
    got = {r["doc_id"]: r for r in linededup.shortened(df).collect()}
    assert got[0]["text"] == "same one\nsame two\nsame three" and got[1]["text"] == ""
    assert all(got[k][n] == f"{n}{k}" for k in range(2) for n in names)
