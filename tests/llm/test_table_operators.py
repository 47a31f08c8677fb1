"""SimHash, top-k, URL reputation, rollups, archives, decontamination and the pipeline."""

import base64
import hashlib
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opinio.llm import arc, decontam, simhash, token_rollup, topk, urlrep
from opinio.llm import queries as Q
from opinio.llm.components import connected_components
from opinio.session import scratch_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA).withColumn("component_id", F.lit("clash"))


def plain_simhash(text):
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(simhash.UPPER, simhash.UPPER.lower())))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, most=3):
    u = sorted(set(fps))
    root = {f: f for f in u}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(u):
        for b in u[i + 1:]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for f in fps]


def test_simhash_and_components_equal_brute_force(spark):
    rnd = random.Random(2)
    base = " ".join(rnd.choice("alpha beta gamma delta eps zeta".split()) + str(rnd.randint(0, 50)) for _ in range(300))
    texts = [(None, base), (100, None), (101, ""), (102, "One"), (103, "one TWO"), (103, "one TWO"), (104, "É one\x0btwo three")]
    for i in range(60):
        words = base.split()
        for _ in range(rnd.randint(0, 12)):
            words[rnd.randrange(len(words))] = "new"
        texts.append((i, " ".join(words)))
    table = docs(spark, texts)
    got = simhash.near_duplicates(table).collect()
    assert len(got) == len(texts)
    fps = [plain_simhash(t) for _, t in texts]
    want = sorted(zip([i for i, _ in texts], fps, plain_components([i for i, _ in texts], fps)), key=str)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == want
    kept = simhash.keep_one(table).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for *_, c in want}) and len(kept[0]) == len(table.columns)


@pytest.mark.parametrize("cell_pairs", [0, 10**9])
def test_links_of_both_ways_connect_the_same(spark, cell_pairs):
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(30)]
    fps = set(centres)
    for c in centres:
        for _ in range(25):
            f = c
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    for most in (0, 3):
        found = simhash.links(frame, most, cell_pairs=cell_pairs, block=8)
        roots = {r.node: r.root for r in connected_components(found).collect()}
        mine = [roots.get(s, s) for s in signed]
        plain = plain_components(signed, fps, most)
        assert len(set(zip(mine, plain))) == len(set(mine)) == len(set(plain))


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (2, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}}


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == [] and simhash.keep_one(docs(spark, [])).collect() == []


# ---- top-k -------------------------------------------------------------------

def test_topk_equals_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, (rnd.normal(0, 0.2, 8) + (i % 3)).tolist(), "x") for i in range(300)]
    rows += [(i, [0.5] * 8, "x") for i in range(300, 420)]  # ties
    rows += [(500, None, "x"), (501, [1.0, None], "x"), (502, [float("nan")] * 8, "x"), (503, [float("inf")] * 8, "x"),
             (None, [1.0] * 8, "x"), (520, [1.0] * 4, "x"), (540, [], "x"), (10, rows[10][1], "x")]
    rows += [(40, [2.0] * 8, "x"), (40, [2.0] * 8, "x"), (60, [3.0, -1.0] * 4, "x"), (33, [4.0] * 8, "x")]  # repeated ids
    rows += [(i, [9.0 + i] * 8, "x") for i in range(601, 620)]  # a shard without queries
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = topk.search(table, F.col("vec_id") % 20 == 0, k=7, pivots=5, shard=9).collect()
    vectors = [(i, np.floor(64 * np.array(v + [0.0] * (8 - len(v))))) for i, v, _ in rows
               if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for own, (q, x) in enumerate(vectors):  # every row but the query's own
        if q % 20 == 0:
            best = sorted((-int(x @ v), i) for at, (i, v) in enumerate(vectors) if at != own)[:7]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_topk_of_few_or_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.search(table, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 2, 12288), (0, 2, 1, 8192)]
    assert topk.search(table.where("false"), F.lit(True)).collect() == []


def test_large_components_stay_exact():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**22, 3.0]])
    assert topk._inner(q, x).tolist() == [[2**60 + 1, 2**62 + 3]]


# ---- URL reputation ----------------------------------------------------------------

def test_rules_and_hosts(spark):
    urls = [(1, "http://A.Example.ORG/es/x?y#z"), (2, "https://example.org/en/12"), (3, "ftp://org"), (4, None), (5, "no scheme"),
            (6, "http://x.com?/fr/"), (7, "http://x.com/fr/"), (None, "http://notorg/"), (2, "https://example.org/en/12")]
    table = spark.createDataFrame([(*u, "x") for u in urls], "page_id long, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule) for r in urlrep.judge(table, Q.URL_RULES).collect()}
    assert got == {(1, "a.example.org", "/es/x", "example.org/es/"), (2, "example.org", "/en/12", "example.org/en/1"), (3, "org", "", None),
                   (4, "", "", None), (5, "", "", None), (6, "x.com", "", None), (7, "x.com", "/fr/", "com/fr/"), (None, "notorg", "/", None)}
    assert urlrep.judge(table, Q.URL_RULES).count() == len(urls) and urlrep.judge(table.where("false"), Q.URL_RULES).collect() == []


def test_reputation_shrinks_to_domain_and_suffix(spark):
    rows = [("bad.evil.com", 0)] * 30 + [("worse.evil.com", 0)] * 30 + [("a.good.com", 1)] * 40 + [("new.evil.com", None), ("b.good.com", None),
                                                                                               ("x.co.uk", None), ("", None)]
    got = {r.host: r for r in urlrep.host_reputation(spark.createDataFrame(rows, "host string, good long")).collect()}
    assert got["bad.evil.com"].upper < 0.5 and got["a.good.com"].mean > 0.9
    assert got["bad.evil.com"].mean < got["new.evil.com"].mean < got["b.good.com"].mean
    assert got["x.co.uk"].suffix == "co.uk" and got["x.co.uk"].domain == "x.co.uk" and got[""].upper > 0.5


# ---- rollups ----------------------------------------------------------------------

def test_rollup_signs_replays_and_edges(spark):
    root = scratch_path(spark, f"t-rollup-{uuid.uuid4().hex}")
    words = {"w": token_rollup.pattern_counter(r"\S+")}
    schema = "seq long, op string, doc_id long, source string, lang string, text string, n_docs string"

    def apply(batch, *rows, counters=words):
        return token_rollup.apply_batch(spark, root, batch, spark.createDataFrame([(*r, "x") for r in rows], schema), counters)

    def state():
        return {tuple(r) for r in token_rollup.totals(spark, root).collect()}

    assert state() == set()
    assert apply(1, (1, "upsert", 1, "a", "en", "one two"), (1, "upsert", 2, "a", None, None), (1, "upsert", None, "a", "en", "x"),
                 (1, "upsert", 3, "b", "en", "x"), (2, "upsert", 3, "b", "en", "x y z"), (1, "delete", 9, "b", "en", None))
    assert state() == {("a", "en", "w", 1, 2), ("a", None, "w", 1, 0), ("b", "en", "w", 1, 3)}
    change = [(1, "upsert", 1, "b", "en", "one"), (1, "delete", 2, None, None, None), (1, "upsert", 4, "a", "en", "q"), (1, "delete", 4, "a", "en", None)]
    assert apply(2, *change) and not apply(2, *change)
    assert state() == {("b", "en", "w", 2, 4)}
    assert apply(3, (1, "upsert", 1, "b", "en", "one"), counters={"v2": token_rollup.pattern_counter(".")})
    assert state() == {("b", "en", "w", 2, 4), ("b", "en", "v2", 1, 3)}
    spark.createDataFrame([(7, "b", "en", "w", 1, 99)], token_rollup._ENTRY).write.parquet(f"{root}/entries/batch=4")  # broke off
    assert state() == {("b", "en", "w", 2, 4), ("b", "en", "v2", 1, 3)}
    assert apply(4, (1, "delete", 1, None, None, None)) and state() == {("b", "en", "w", 1, 3)}


# ---- archives -----------------------------------------------------------------------

def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(arc, "ARCHIVE_BYTES", 400)  # several archives of both versions
    root = scratch_path(spark, f"t-arc-{uuid.uuid4().hex}")
    bodies = [(5, b"same"), (3, b"same"), (None, b"same"), (4, b"WARC/1.0\r\n\r\nnot a record\n"), (6, None), (2, b""), (7, b"\xff\xfe bytes"),
              (8, b"l\r\n\r\n" * 50), (9, b"own"), (9, b"own")]
    rows = spark.createDataFrame([(k, f"http://h/{k} a\n", "20240102030405", b, "x") for k, b in bodies],
                                 "key long, url string, date string, body binary, place string").repartition(2)
    arc.write_arc(rows, f"{root}/arc")
    arc.convert(spark, f"{root}/arc", f"{root}/warc")
    records = arc.with_references(arc.read_warc(spark, f"{root}/warc")).collect()
    assert len(records) == len(bodies) and {r.date for r in records} == {"2024-01-02T03:04:05Z"}
    assert len({r.record_id for r in records}) == len(records)
    plain = {k: b or b"" for k, b in bodies}
    for r in records:
        assert r.payload_bytes == len(plain[r.key])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(plain[r.key]).digest()).decode()
        if r.record_type == "response":
            assert bytes(r.payload) == plain[r.key] and r.refers_to is None
    assert {r.key: r.refers_to for r in records if r.record_type == "revisit"} == {5: 3, None: 3, 6: 2, 9: 9}


def test_short_and_foreign_archives_are_refused():
    block = arc.arc_version_block(1, "x.arc", "20240102030405") + b"\n"
    with pytest.raises(ValueError):
        list(arc.parse_arc(block + arc.arc_record(1, "u", "20240102030405", b"abc", 0, "x")[:-1]))
    with pytest.raises(ValueError):
        list(arc.parse_arc(block.replace(b"\n1 0", b"\n3 0")))


def test_no_pages_give_no_records(spark):
    root = scratch_path(spark, f"t-arc-{uuid.uuid4().hex}")
    arc.write_arc(spark.createDataFrame([], "key long, url string, date string, body binary"), f"{root}/arc")
    arc.convert(spark, f"{root}/arc", f"{root}/warc")
    assert arc.read_warc(spark, f"{root}/warc").collect() == []


# ---- decontamination --------------------------------------------------------------------

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_overlap(texts, items):
    low = lambda t: _WORDS.findall((t or "").translate(str.maketrans(simhash.UPPER, simhash.UPPER.lower())))
    windows = {}
    for item, text in items:
        w = low(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(item)
    out = []
    for doc, text in texts:
        w, hit, found = low(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (items_here := windows.get(tuple(w[i:i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= items_here
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_overlap_equals_brute_force(spark, short):
    rnd = random.Random(4)
    word = lambda: rnd.choice("a b c d".split())  # noqa: E731  many ties between k-grams
    items = [(i, " ".join(word() for _ in range(rnd.randint(13, 30)))) for i in range(6)]
    items += [(20, items[0][1].upper()), (None, items[1][1]), (21, None), (22, ""), (23, "é " * 14)]
    if short:
        items += [(30, "d d d d"), (31, "a b c d a b c"), (32, "c, B; a b a b a b a b a b"), (33, "zzz")]
    texts = [(i, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    texts += [(100 + i, f"x y {t} z") for i, t in items if t and i is not None]
    texts += [(200, None), (201, ""), (None, items[2][1]), (202, items[3][1]), (202, items[3][1]), (203, "q " * 3000 + items[4][1]),
              (204, " ".join(["a"] * 400)), (205, items[5][1] + " " + items[5][1])]
    table = docs(spark, texts).withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    key = lambda r: str(r)
    got = sorted((tuple(r) for r in decontam.overlap(table, bench).collect()), key=key)
    want = sorted(plain_overlap(texts, items), key=key)
    assert got == want
    kept = decontam.drop_contaminated(table, bench)
    assert kept.columns == table.columns and kept.count() == sum(not r[-1] for r in want)


def test_overlap_with_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.overlap(docs(spark, [(1, "a b")]), none).collect()
    assert [tuple(r) for r in got] == [(1, 2, 0, [], False)]
    assert decontam.overlap(docs(spark, []), none).collect() == []


# ---- pipeline -----------------------------------------------------------------------------

def test_pipeline_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 !!", None, "s", 0),
                                   (None, "mail me at a@b.co or not, the of and to in", "en", None, 0)], SCHEMA)
    docs_ = table.select("doc_id", "text", "lang", "source", "n_chars").union(extra)
    docs_.write.parquet(path := scratch_path(spark, f"t-docs-{uuid.uuid4().hex}"))
    docs_ = spark.read.parquet(path)
    sizes = [docs_.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs_, stage(spark, docs_, SF)
        out.write.parquet(path := scratch_path(spark, f"t-{name}-{uuid.uuid4().hex}"))
        docs_ = spark.read.parquet(path)
        sizes.append(docs_.count())
        if name != "byte_bpe":
            assert docs_.columns == before.columns
        if name == "language_id":
            assert not {10**6, 10**6 + 1} & {r.doc_id for r in docs_.collect()}
        if name == "mask_pii":
            assert not docs_.where("text like '%a@b.co%'").count()
            assert docs_.where(F.length("text") != F.col("n_chars")).count() == 0
    assert sizes[0] - 2 == sizes[1] >= sizes[2] >= sizes[3] == sizes[4] == sizes[5]
    assert docs_.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_of_no_documents(spark):
    docs_ = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_, SF).collect() == []
