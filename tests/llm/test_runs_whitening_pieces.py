"""Periodic runs, embedding whitening and SentencePiece: the operators against brute
force or the library, the queries on their whole tables, and the edge cases."""

import hashlib
import random
import re
import struct
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.llm import pieces, squares, whitening
from opinio.llm import queries as Q

SF = "/root/testdata/sf0.001"
SEPARATORS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


# ---- periodic runs -------------------------------------------------------------

def plain_runs(words, shortest=6, exponent=4):
    """(start, length, period): every period by itself; a stretch counts once, under its smallest one."""
    words, found = np.array(words), {}
    for period in range(1, len(words) // exponent + 1):
        same = np.concatenate(([0], (words[:-period] == words[period:]).astype(int), [0]))
        begins, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for begin, end in zip(begins.tolist(), ends.tolist()):
            if end + period - begin >= max(shortest, exponent * period):
                found.setdefault((begin, end + period - begin), period)
    return sorted((start, length, period) for (start, length), period in found.items())


def random_words(rnd):
    letters, words = rnd.choice([1, 2, 2, 3, 6]), []
    for _ in range(rnd.randint(0, 8)):
        unit = [rnd.randrange(letters) for _ in range(rnd.randint(1, 9))]
        words += unit * rnd.randint(1, 7) + unit[:rnd.randint(0, len(unit))] + [rnd.randrange(letters)] * rnd.randint(0, 2)
    return words


def test_catcher_equals_brute_force_however_words_are_appended():
    rnd = random.Random(5)
    for _ in range(600):
        words, shortest, exponent = random_words(rnd), rnd.choice([2, 6]), rnd.choice([3, 4, 5])
        catcher, at = squares.SquareCatcher(shortest, exponent), 0
        while at < len(words):
            size = rnd.choice([1, 3, 17, 400])
            catcher.append(np.array(words[at:at + size]))
            at += size
        assert [tuple(r) for r in catcher.runs().tolist()] == plain_runs(words, shortest, exponent)


def test_runs_are_reported_while_words_arrive():
    catcher = squares.SquareCatcher()
    catcher.append(np.array([9, 1, 2] + [1, 2] * 2))
    assert len(catcher.runs()) == 0
    catcher.append(np.array([1, 2]))
    assert catcher.runs().tolist() == [[1, 8, 2]]
    catcher.append(np.array([1, 7]))
    assert catcher.runs().tolist() == [[1, 9, 2]]


def test_long_sequences():
    block = np.random.default_rng(0).integers(0, 1 << 30, 30_000)
    words = np.concatenate(([-1], np.tile(block, 5), block[:7], np.zeros(50_000)))
    catcher = squares.SquareCatcher()
    for part in np.array_split(words, 7):
        catcher.append(part)
    assert catcher.runs().tolist() == [[1, 150_007, 30_000], [150_008, 50_000, 1]]
    thue_morse = [0]
    while len(thue_morse) < 1 << 15:  # sums of a rolling hash agree here, words don't
        thue_morse += [1 - x for x in thue_morse]
    catcher = squares.SquareCatcher()
    catcher.append(np.array(thue_morse))
    assert len(catcher.runs()) == 0
    with pytest.raises(ValueError):
        squares.SquareCatcher(exponent=2)


def test_find_runs_edges(spark):
    texts = [(1, "a b " * 4 + "c"), (1, "a b " * 4 + "c"), (None, "x y z\x1cq\x85 " * 6), (3, None), (4, ""), (5, " \t\n\x0b"),
             (6, "a " * 6 + "b " * 6), (7, "w"), (8, "a a a a a"), (9, "long " * 300_000)]
    rows = spark.createDataFrame([(i, t, "mine", "clash") for i, t in texts], "doc_id long, text string, runs string, _n string")
    got = squares.find_runs(rows)
    assert got.columns == ["doc_id", "text", "runs", "_n", "repeats"]
    for row in got.collect():
        words = SEPARATORS.findall(row.text or "")
        found = [(r.start, r.length, r.period) for r in row.repeats.runs]
        if row.doc_id == 9:
            assert found == [(0, 300_000, 1)] and row.repeats.collapsed == "long"
            continue
        numbers = {w: i for i, w in enumerate(words)}
        assert found == plain_runs([numbers[w] for w in words]) and row.repeats.n_words == len(words)
        assert (row.runs, row._n) == ("mine", "clash")
        dropped = {j for start, length, period in found for j in range(start + period, start + length)}
        assert row.repeats.collapsed == " ".join(w for j, w in enumerate(words) if j not in dropped)
    assert squares.find_runs(rows.where("false")).collect() == []
    replaced = squares.find_runs(rows.withColumn("repeats", F.lit("old")).limit(1))
    assert replaced.columns.count("repeats") == 1 and replaced.first().repeats.n_words > 0


def test_op11_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op11_periodic_runs(spark, SF).collect()
    assert len(got) == len(texts) and sum(r.n_runs > 0 for r in got) > 5
    for r in got:
        words, h = SEPARATORS.findall(texts[r.doc_id] or ""), crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        numbers = {w: i for i, w in enumerate(words)}
        runs = plain_runs([numbers[w] for w in words])
        best = max(runs, key=lambda run: (run[1], -run[0], -run[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join("%d,%d,%d\n" % run for run in runs).encode())
        dropped = {j for start, length, period in runs for j in range(start + period, start + length)}
        assert r.collapsed_sha256 == sha(" ".join(w for j, w in enumerate(words) if j not in dropped).encode())


# ---- whitening -----------------------------------------------------------------

def plain_whitening(vectors, components=16):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, exact, (x - sums / n) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_polar_split_gives_eigenvectors():
    draw = np.random.default_rng(0)
    matrices = [np.diag([3.0, 1.0, 2.0]), np.eye(5) * 4, np.zeros((4, 4)), np.diag([-1.0, 0.0, 1.0]), np.array([[7.0]])]
    for d in (2, 17, 64):
        q, _ = np.linalg.qr(draw.standard_normal((d, d)))
        matrices += [q * draw.integers(0, 4, d) @ q.T, q * np.logspace(0, -9, d) @ q.T]
    for v in matrices:
        v = (v + v.T) / 2
        values, axes = whitening.eigenvectors(v)
        size = max(np.linalg.norm(v), 1.0)
        assert np.abs(values - np.linalg.eigvalsh(v)[::-1]).max() < 1e-13 * size
        assert np.abs(v @ axes - axes * values).max() < 1e-13 * size
        assert np.abs(axes.T @ axes - np.eye(len(v))).max() < 1e-13
        few, first = whitening.eigenvectors(v, 2)
        assert np.abs(few - values[:2]).max() < 1e-13 * size and first.shape[1] == min(2, len(v))


def test_polar_factor():
    a = np.random.default_rng(2).standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar_factor(a)
    left, _, right = np.linalg.svd(a)
    assert np.abs(u - left @ right).max() < 1e-12


def test_op12_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, exact, whitened, explained = plain_whitening([r.embedding for r in rows])
    got = {(r.vec_id, r.component): r for r in Q.op12_whitening(spark, SF).collect()}
    assert len(got) == 16 * len(rows)
    signs = np.sign([got[rows[0].vec_id, c + 1].whitened * whitened[0, c] for c in range(16)])
    for i, row in enumerate(rows):
        for c in range(16):
            r = got[row.vec_id, c + 1]
            assert (r.n, r.deviation) == (n, exact[i])
            assert abs(r.whitened * signs[c] - whitened[i, c]) < 1e-8
            assert abs(r.explained - explained[c]) < 1e-12 and r.identity_error < 1e-9


def test_whitening_edges(spark):
    draw = np.random.default_rng(4)
    good = [draw.standard_normal(3).tolist() for _ in range(40)]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(0, good[0], "x"), (None, good[1], "x")]
    rows += [(100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [float("nan")] * 3, "x"), (103, [float("-inf")] * 3, "x"),
             (104, [1.0, 2.0], "x"), (105, [], "x")]
    rows += [(200 + i, good[2], "x") for i in range(30)]  # copies count once in the fit list
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    got = whitening.fit_and_whiten(table).collect()
    n, exact, whitened, _ = plain_whitening(good)
    assert len(got) == 3 * 72 and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3}
    assert {r.deviation for r in got if r.vec_id == 229} == {exact[2]}
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.vec_id == 5), sorted(np.abs(whitened[5])))
    assert whitening.fit_and_whiten(table.where("false")).collect() == []
    assert whitening.fit_and_whiten(table.where("vec_id = 100")).collect() == []
    single = whitening.fit_and_whiten(table.where("vec_id = 5")).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation, r.identity_error) for r in single] == [(c, 0.0, 0.0, 0, 0.0) for c in (1, 2, 3)]
    flat = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    second = [r for r in whitening.fit_and_whiten(flat).collect() if r.component == 2]
    assert {r.whitened for r in second} == {0.0} and second[0].identity_error < 1e-12  # no variance in dimension 2


def test_far_offset_and_large_counts_stay_exact():
    w = whitening.Whitener(1 << 30, np.array([(1 << 30) * 1_000_000 + 3, 5]), np.eye(2), np.ones(2), 2.0)
    x = np.array([[1_000_000, 0], [1_000_001, 1], [1_000_003, 1 << 20]])
    want = [sum(((1 << 30) * int(a) - int(s)) ** 2 for a, s in zip(row, w.sums)) for row in x]
    assert w.deviations(x) == [v if v < 1 << 63 else None for v in want] and w.deviations(x)[2] is None
    assert w.centred(x)[0, 0] == -3 / (1 << 30)


# ---- SentencePiece -------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())


@pytest.fixture(scope="module")
def piece_model():
    return pieces._model(pieces._read(Q.piece_model()))


def test_encoding_equals_the_library(library, piece_model):
    rnd = random.Random(8)
    known = list(piece_model.ids)
    texts = [" " * n for n in range(70)] + ["", "▁", "a▁▁b", "\0", "<s>", "</s> <0x41> <unk>", "e" * 5000, "\n" * 50, "ab" * 300]
    for _ in range(2500):
        texts.append("".join(rnd.choice("ab e\n\t ▁é中\U0001f600́\x00'0") for _ in range(rnd.randint(0, 50))))
        texts.append("".join(rnd.choice(known).replace("▁", " ") for _ in range(rnd.randint(1, 12))))
        texts.append("".join(chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(0xE000, 0x10FFFF)])) for _ in range(9)))
    for text in texts:
        ids = library.encode(text, add_bos=True, add_eos=True)
        data = struct.pack(f"<{len(ids)}I", *ids)
        assert piece_model.encode(text) == data and piece_model.decode(data) == library.decode(ids)


def test_decoding_of_any_ids_equals_the_library(library, piece_model):
    rnd = random.Random(9)
    for _ in range(4000):
        ids = [rnd.choice([0, 1, 2, rnd.randrange(3, 259), rnd.randrange(32000)]) for _ in range(rnd.randint(0, 8))]
        assert piece_model.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids)


def test_long_texts_are_sliced_between_stretches(library, piece_model, monkeypatch):
    text = "".join(random.Random(1).choice(["word", " ", "  ", "\n", "x" * 40, " the"]) for _ in range(3000))
    monkeypatch.setattr(pieces, "_SLICE", 100)
    monkeypatch.setattr(pieces, "KEPT_STRETCHES", 50)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 50)
    model = pieces.PieceModel(pieces._read(Q.piece_model()))
    want = library.encode(text, add_bos=True, add_eos=True)
    assert model.encode(text) == struct.pack(f"<{len(want)}I", *want) == piece_model.encode(text)
    blank = model.encode(" " * 3000)
    assert np.frombuffer(blank, "<u4").tolist() == library.encode(" " * 3000, add_bos=True, add_eos=True)


def test_backtracking_with_a_pieces_dead_end():
    """A longest piece that can't be kept: 'abc' is longest at 0, but merging gives a + bc + d..."""
    entry = lambda piece, score, kind=1: b"\x0a" + bytes([len(e := b"\x0a" + bytes([len(piece)]) + piece + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))]) + e
    vocabulary = [(b"a", -9), (b"b", -8), (b"c", -7), (b"d", -6), (b"ab", -5), (b"abc", -4), (b"cd", -1), (b"bcd", -2)]
    data = entry(b"<unk>", 0, 2) + b"".join(entry(p, s) for p, s in vocabulary) + b"".join(entry(b"<0x%02X>" % i, 0, 6) for i in range(256))
    trainer, normalizer = b"\x18\x02\x98\x02\x01", b"\x18\x00\x20\x00"
    model = pieces.PieceModel(data + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(normalizer)]) + normalizer)
    rnd = random.Random(2)
    for text in ["abcd", "abcabcd", "cdabcdd"] + ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 25))) for _ in range(800)]:
        assert [model.pieces[i] for i in model.backtracked(text)] == model.merged(text)


def test_pieces_are_looked_up_only_where_one_is_put():
    """The automaton gives one piece a place of the way, not every piece that begins at any character."""
    model = pieces.PieceModel(pieces._read(Q.piece_model()))
    found = model.automaton
    given = []

    class Counted:
        longest_prefix = staticmethod(lambda ahead: given.append(ahead) or found.longest_prefix(ahead))

        def __getattr__(self, name):
            return lambda text: (given.append(x) or x for x in getattr(found, name)(text))

    model.automaton = Counted()
    rnd = random.Random(5)
    put = 0
    for _ in range(300):
        text = "▁" + "".join(rnd.choice(["the", "ing", "nd", "or", "ea", "sh", "tion", "wh", "s"]) for _ in range(4))
        got = model.backtracked(text)
        assert [model.pieces[i] for i in got] == model.merged(text)
        put += len(got)
    assert len(given) < 2 * put


def test_unsupported_models_are_refused(tmp_path):
    with open(Q.piece_model(), "rb") as file:
        data = file.read()
    for path, change in (("unigram", data + b"\x12\x05\x18\x01\x98\x02\x01"), ("trimming", data + b"\x1a\x04\x18\x01\x20\x01")):
        (tmp_path / path).write_bytes(change)
        with pytest.raises(ValueError):
            pieces._read(str(tmp_path / path))


def test_piece_edges(spark, library):
    texts = [(1, "Hello  world"), (1, "Hello  world"), (None, "x"), (2, None), (3, ""), (4, "퟿▁\n" * 9), (5, "word " * 150_000)]
    rows = spark.createDataFrame([(i, t, "mine") for i, t in texts], "doc_id long, text string, n_tokens string")
    encoded = pieces.encode(rows, Q.piece_model())
    assert encoded.columns == ["doc_id", "text", "n_tokens", "pieces"]
    decoded = pieces.decode(encoded.withColumn("ids", F.col("pieces.ids")), Q.piece_model()).collect()
    assert len(decoded) == len(texts)
    for r in decoded:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == library.decode(ids) and r.n_tokens == "mine"
        assert r.pieces.n_tokens == len(ids)
    assert pieces.encode(rows.where("false"), Q.piece_model()).collect() == []
    assert pieces.decode(spark.createDataFrame([(None,)], "ids binary"), Q.piece_model()).first().decoded == ""


def test_op13_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op13_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)))
        assert r.decoded_sha256 == sha(library.decode(ids).encode())
