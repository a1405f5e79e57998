"""Filter audit, web archives and token alignment: brute force, planted damage, round trips."""

import base64
import collections
import gzip
import hashlib
import itertools
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigraph.llm import align, audit, queries, warc
from lexigraph.plans.scale import work_dir
from tools.check import normal

FOLDER = "/root/testdata/sf0.001"
RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_warc"])
def test_queries_match_sql(spark, db, name):
    got, want = queries.all_queries()[name](spark, FOLDER).toPandas(), db.sql(queries.all_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got.astype(object).where(got.notna(), None)) == normal(want.astype(object).where(want.notna(), None))


# --- filter audit


def brute_masks(rows):
    """(part, mask) of each (id, text, part)."""
    out = []
    for i, t, p in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
                 i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)]
        out.append((p or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


def test_audit_retracts_when_smaller_ids_come_later(spark):
    """Ids arrive in falling order over several files, so that nearly every batch retracts; nulls, ties, repeated rows, clashing names."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(9, long, "a"), (9, long, "b"), (8, long, "a"), (7, "X $", "b"), (7, None, "b"), (6, "", None), (5, long, "b"), (5, long, "b"), (5, long, "c"), (None, long, "a"), (3, "X $", "a"),
            (2, long + " " + long, "a"), (1, long, "c"), (1, None, "c")]
    path = work_dir(spark, "audit_in")
    for k in range(0, len(rows), 2):
        spark.createDataFrame([(*r, 1, "x") for r in rows[k:k + 2]], "doc_id long, text string, source string, mask int, digest string").coalesce(1).write.mode("append").parquet(path)
    labels = spark.createDataFrame([(5, 1, 0), (1, 1, 1), (1, 0, 0), (9, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    counts = audit.counters(spark, path, labels, batches=7)
    good, bad = {5, 1}, {1, 9}
    want = collections.Counter((p, m, int(r[0] in good), int(r[0] in bad)) for r, (p, m) in zip(rows, brute_masks(rows), strict=True))
    assert {(r["part"], r["mask"], r["quality"], r["toxic"]): r["n"] for r in counts.collect()} == dict(want)
    assert sorted(audit.counters(spark, path, labels, batches=1).collect()) == sorted(counts.collect())
    # The report against each order walked document by document.
    report = {(r["part"], r["filter_order"], r["step"]): r for r in audit.interactions(counts).collect()}
    assert len(report) == 600 * 4
    for order in list(itertools.permutations("ABCDE"))[::17]:
        for part in ("", "a", "b", "c"):
            left = [(m, g, b) for (p, m, g, b), n in want.items() for _ in range(n) if p == part]
            every = list(left)
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                out, left = [x for x in left if x[0] & bit], [x for x in left if not x[0] & bit]
                r = report[part, "".join(order), step]
                assert (r["kept"], r["removed"], r["good_lost"], r["toxic_lost"]) == (len(left), len(out), sum(x[1] for x in out), sum(x[2] for x in out))
                assert r["redundant"] == sum(1 for x in every if x[0] & bit) - len(out) and r["unique_fails"] == sum(1 for x in every if x[0] == bit)
                assert r["shapley"] == sum(120 // x[0].bit_count() for x in every if x[0] & bit)


def test_audit_of_an_empty_table(spark):
    path = work_dir(spark, "audit_none")
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(path)
    assert audit.audit(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- web archives


def test_archives_of_odd_pages(spark):
    pages = [(1, "u\r\nX: y", "<p>"), (2, None, "<p>"), (None, "z", "<p>"), (5, "a", None), (6, "b", ""), (2, None, "<p>"), (None, "q", "é" * 3), (7, "c", "WARC/1.1\r\n\r\nx" * 9), (8, "d", "\0\x1f\u008b\n\r\n\r\n")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, refers_to string")
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in pages:
        h = (h or "").encode()
        ids = [j for j, _, g in pages if (g or "").encode() == h and j is not None]
        top = max(ids, default=None)
        want.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=str)
    # Payloads of under ``least`` bytes are all responses; urls come back; nothing is a gap.
    folder = work_dir(spark, "warc")
    warc.write(df, folder, least=4, archive=300)
    found = warc.read(spark, folder, id_type="long")
    assert found.filter("kind = 'gap'").count() == 0 and found.filter("record_type = 'revisit'").count() == 0
    back = found.filter("record_type = 'response'").select("page_id", "url", F.col("payload").cast("string").alias("html"))
    assert sorted(map(str, back.collect())) == sorted(str(r) for r in spark.createDataFrame([(i, u and u.replace("\r\n", "%0D%0A").replace(" ", "%20"), h or "") for i, u, h in pages], back.schema).collect())
    assert found.select("archive").distinct().count() > 3
    assert warc.round_trip(df.limit(0)).count() == 0


def archive(n=12, zipped=True, seed=0):
    rng = np.random.default_rng(seed)
    parts = [warc.page_record(i, f"http://h/{i}", rng.bytes(int(rng.integers(0, 400))) + b"<p>\n", None, "1970-01-01T00:00:00Z") for i in range(n)]
    return [warc.member(p) if zipped else p for p in parts]


@settings(max_examples=60, deadline=None)
@given(st.booleans(), st.integers(0, 5), st.lists(st.tuples(st.integers(0, 11), st.sampled_from(["flip", "cut", "insert", "drop"]), st.floats(0, 0.999)), max_size=4))
def test_salvage_recovers_every_record_that_is_whole(zipped, seed, harm):
    parts = archive(zipped=zipped, seed=seed)
    hurt = dict((k, (how, at)) for k, how, at in harm)
    data, places = b"", {}
    for k, p in enumerate(parts):
        if k in hurt:
            how, at = hurt[k]
            i = int(at * len(p))
            p = {"flip": p[:i] + bytes([p[i] ^ 255]) + p[i + 1:], "cut": p[:i], "insert": p[:i] + b"noise" + p[i:], "drop": p[:i] + p[i + 7:]}[how]
        else:
            places[k] = (len(data), len(p))
        data += p
    rows = list(warc.salvage(data))
    # What is whole is found at its place (a byte of an unzipped header may also be wrong without a trace, so others may be found).
    found = {(r[1], r[2]): r[3]["warc-record-id"] for r in rows if r[0] == "record"}
    assert {at: found.get(at) for at in places.values()} == {at: f"<urn:page:{k}>" for k, at in places.items()}
    # A gap is exactly what no record or padding covers, and each hurt record that did not survive lies in one.
    covered = bytearray(len(data))
    for r in rows:
        assert not any(covered[r[1]:r[1] + r[2]])
        covered[r[1]:r[1] + r[2]] = b"\1" * r[2]
    assert not re.search(rb"[^\0\r\n]", bytes(x for x, c in zip(data, covered, strict=True) if not c))
    assert all(r[3] for r in rows if r[0] == "gap")


def test_salvage_names_what_failed():
    (a, b), plain = archive(2), archive(2, zipped=False)
    wrong = warc.record("resource", [("WARC-Record-ID", "<urn:page:5>"), ("WARC-Date", "x")], b"body").replace(b"body", b"bodY")
    reason = lambda data: [r[3] for r in warc.salvage(data) if r[0] == "gap"]
    assert reason(a[:-3]) == ["member cut short"] and reason(a[:40] + bytes([a[40] ^ 1]) + a[41:] + b) == ["member does not decompress"]
    assert reason(wrong) == ["wrong block digest"] and reason(plain[0][:-9] + plain[1]) == ["no end behind the block"] or reason(plain[0][:-9] + plain[1]) == ["wrong block digest"]
    assert reason(b"junk" + a) == ["no version line"] and reason(b"\r\n\0" + a + b"\0" + b) == []
    assert reason(gzip.compress(b"no record")) == ["no version line"] and reason(b"WARC/1.1\r\nX: 1\r\n\r\n") == ["missing header field"]
    two = gzip.compress(plain[0] + plain[1])  # two records in one member
    assert [r[0] for r in warc.salvage(two)] == ["record", "record"]


def test_reader_logs_gaps_of_damaged_files(spark, tmp_path):
    parts = archive(6)
    (tmp_path / "x.warc.gz").write_bytes(parts[0] + parts[1][:-9] + parts[2] + parts[3] + b"garbage" + parts[4])
    (tmp_path / "y.warc").write_bytes(b"".join(archive(3, zipped=False)))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(int(r["page_id"]) for r in rows if r["archive"].endswith("gz") and r["kind"] == "record") == [0, 2, 3, 4]
    gaps = sorted((r["offset"], r["length"], r["reason"]) for r in rows if r["kind"] == "gap")
    at = len(parts[0]) + len(parts[1]) - 9
    assert [g[:2] for g in gaps] == [(len(parts[0]), len(parts[1]) - 9), (at + len(parts[2]) + len(parts[3]), 7)]
    assert len(rows) == 4 + 2 + 3


# --- token alignment


@pytest.fixture(scope="module")
def coders():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def brute_tokens(text, coders):
    """Ids and bytes of both sides, or nothing."""
    tok, piece = coders
    if not text:
        return [], [], [], []
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(x for x in range(256) if x not in shown)}
    da = [bytes(back[c] for c in tok.id_to_token(i)) for i in a]
    db = [bytes([int(s[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", s) else s.replace("▁", " ").encode() for s in map(piece.id_to_piece, b)]
    return (a, b, da, db) if b"".join(da) == b"".join(db) == b" " + text.encode() else ([], [], [], [])


def brute_links(text, coders):
    a, b, da, db = brute_tokens(text, coders)
    ea, eb = list(itertools.accumulate(map(len, da))), list(itertools.accumulate(map(len, db)))
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if ea[i] == eb[j]]
    groups, last = [], 0
    for e in sorted(set(ea) & set(eb)):
        groups.append("|".join(",".join(str(t) for t, x in zip(ids, ends, strict=True) if last < x <= e) for ids, ends in ((a, ea), (b, eb))))
        last = e
    return len(a), len(b), links, ";".join(groups)


def brute_measures(texts, coders):
    each = [brute_links(t, coders) for t in texts]
    count = collections.Counter(x for _, _, links, _ in each for x in links)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return [(na, nb, g.count(";") + 1 if g else 0, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, links, g in each]


ODD = ["", None, "a▁b", "x   y\n\n\tz <s> </s> <unk> <|endoftext|>", "日本語🎉 é́ ﬁ", "  lead", "\0", "a" * 300, "hello world, this is a test", "hello world, this is a test", "don't   stop"]
COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sent", [align.SENT, 3, 0])
def test_alignment_against_brute_force(spark, coders, sent):
    """Also with few or no pairs broadcast: the rest comes by the shuffle."""
    texts = ODD + [r["text"][:600] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1)], "doc_id long, text string, pairs int")
    got = {r["doc_id"]: tuple(r[c] for c in COLS) for r in align.measure(df, RANKS, MODEL, sent).collect()}
    want = brute_measures([*texts, "null id"], coders)
    assert [got[i] for i in range(len(texts))] + [got[None]] == want
    assert align.measure(df.limit(0), RANKS, MODEL).count() == 0


@pytest.mark.parametrize("work", [1, 2, 7, 4096])
def test_pieces_of_any_size_give_the_same_groups(coders, work):
    x = align.align(ODD, RANKS, MODEL, work)
    assert align.group_texts(x, RANKS, MODEL) == [brute_links(t, coders)[3] for t in ODD]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.lists(st.integers(1, 5), min_size=1, max_size=40), st.integers(1, 9))
def test_merge_path_against_brute_force(x, y, work):
    """Two tokenisations of one text: pieces are of equal work and their overlaps are all overlaps."""
    a, b = np.cumsum(x), np.cumsum(y)
    n = max(a[-1], b[-1])
    a, b = (np.append(e, n) if e[-1] < n else e for e in (a, b))
    i, j = align.diagonals(a, b, work)
    assert (np.diff(i + j)[:-1] == work).all() and (i[-1], j[-1]) == (len(a), len(b))
    found = [t for p in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True) for t in zip(*align.overlaps(a, b, *p), strict=True)]
    sa, sb = np.append(0, a[:-1]), np.append(0, b[:-1])
    want = [(p, q, a[p] == b[q]) for p in range(len(a)) for q in range(len(b)) if max(sa[p], sb[q]) < min(a[p], b[q])]
    assert sorted(found) == sorted(want)


def test_overlaps_cover_the_text(spark):
    text = "Überraschung! 12,345 tokens\n\n  and more 日本"
    rows = align.token_overlaps(spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id int, text string"), RANKS, MODEL).orderBy("doc_id", "end").collect()
    for d in (1, 3):
        mine = [r for r in rows if r["doc_id"] == d]
        assert sum(r["size"] for r in mine) == mine[-1]["end"] == len(text.encode()) + 1 and mine[-1]["together"] and mine[0]["place_a"] == mine[0]["place_b"] == 0


def test_alignment_of_very_long_runs():
    """A run of blanks that the first pattern can't take, and a very long text in one go."""
    for text in (" " * 1_200_000 + "x", "word " * 200_000):
        x = align.align([text], RANKS, MODEL)
        assert x.ends[0][-1] == x.ends[1][-1] == len(text) + 1 and x.both[-1]
