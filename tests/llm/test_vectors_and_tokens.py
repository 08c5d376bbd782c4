"""Vector codes, centroid clusters and byte-level BPE against brute force and the tokenizer library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridloom.llm import ball_codes, bisectors, byte_bpe, queries

VECTORS = "vec_id long, embedding array<float>, label int, codes string, q string, tally string, of string"
NAN, INF = float("nan"), float("inf")


def made(n, size, seed=0, spread=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (spread, size))
    x = centres[rng.integers(0, spread, n)] + rng.normal(0, 0.2, (n, size))
    x[::7] = np.round(x[::7])  # ties
    x[n // 2 : n // 2 + n // 4] = x[3]  # one very common vector
    return [(i, [float(v) for v in row], (None, 1, 2)[i % 3], "a", "b", "c", "d") for i, row in enumerate(x.astype(np.float32))]


BAD = [(9001, None, 1, *"abcd"), (9002, [1.0] * 31 + [None], 1, *"abcd"), (9003, [NAN] * 32, 1, *"abcd"), (9004, [INF] * 32, 2, *"abcd")]


def floors(x, scale):
    return np.floor(np.asarray(x, np.float32).astype(np.float64) * scale).astype(np.int64)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    x = floors([r[1] for r in rows], 256).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        best = d.argmin(-1)
        if k < rounds:
            for m in range(parts):
                for j in range(len(books[m])):
                    mine = x[best[:, m] == j, m]
                    if len(mine):
                        books[m, j] = [int(s) // len(mine) for s in mine.sum(0)]
    return best, d.min(-1).sum(-1), hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def test_op11_equals_comparing_all_entries(spark):
    rows = made(700, 32)
    got = {r["vec_id"]: r for r in ball_codes.op11_ball_codes(spark.createDataFrame(rows + BAD, VECTORS).repartition(5)).collect()}
    best, error, books = brute_codes(rows)
    assert sorted(got) == [r[0] for r in rows]
    by_label = {k: int(sum(e for e, r in zip(error, rows, strict=True) if r[2] == k)) for k in (None, 1, 2)}
    for r, c, e in zip(rows, best, error, strict=True):
        assert got[r[0]]["code"] == bytes(c.tolist()).hex() and got[r[0]]["error"] == e
        assert got[r[0]]["label_error"] == by_label[r[2]] and got[r[0]]["codebooks_sha256"] == books


def test_balls_leave_work_out_and_lose_nothing():
    rng = np.random.default_rng(3)
    entries = rng.integers(-900, 900, (64, 3))
    x = entries[rng.integers(0, 64, 5000)] + rng.integers(-60, 60, (5000, 3))
    own, far = ball_codes.nearest(x, entries)
    radius = np.array([int(np.sqrt(far[own == j].max(initial=0))) + 2 for j in range(64)])
    moved = entries + rng.integers(-9, 9, entries.shape)
    balls = ball_codes.Balls(moved, radius + 17)
    best, least, compared = balls.reassign(x, own)
    want, far = ball_codes.nearest(x, moved)
    assert (best == want).all() and (least == far).all()
    assert compared < len(x) / 2 and max(map(len, balls.near)) < 63


def test_op11_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert ball_codes.op11_ball_codes(empty).collect() == []
    few = made(5, 16) + [(5, [1.0] * 16, 1, *"abcd"), (5, [1.0] * 16, 1, *"abcd"), (None, [2.0] * 16, None, *"abcd"), (7, [1.0] * 9, 2, *"abcd"), (8, [], 2, *"abcd"), (9, [3e38] * 16, 3, *"abcd")]
    got = ball_codes.op11_ball_codes(spark.createDataFrame(few, VECTORS)).collect()
    assert len(got) == len(few) and sum(r["code"] is None for r in got) == 2  # other lengths stay without a code
    assert all(r["error"] == 0 for r in got if r["code"])  # each row is an entry
    assert all(r["code"] is None for r in ball_codes.op11_ball_codes(spark.createDataFrame([(1, [1.0] * 9, 2, *"abcd")], VECTORS)).collect())


def brute_clusters(rows):
    rows = sorted(rows, key=lambda r: hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest())
    x = floors([r[1] for r in rows], 1024)
    c = x[:8].copy()
    for k in range(11):
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        best = d.argmin(1)
        for j in range(len(c) if k < 10 else 0):
            if (best == j).any():
                c[j] = [int(s) // int((best == j).sum()) for s in x[best == j].sum(0)]
    return {r[0]: (b, m) for r, b, m in zip(rows, best.tolist(), d.min(1).tolist(), strict=True)}, [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]


def test_op13_equals_comparing_all_centroids(spark):
    rows = made(600, 64, seed=4) + [(None, [0.5] * 64, 1, *"abcd")]
    odd = [(9001, None, 1, *"abcd"), (9002, [1.0] * 63, 1, *"abcd"), (9003, [1.0] * 63 + [NAN], 1, *"abcd"), (9004, [1.0] * 65, 2, *"abcd"), (9005, [1.0] * 63 + [None], 2, *"abcd")]
    got = bisectors.op13_bisector_clusters(spark.createDataFrame(rows + odd, VECTORS).repartition(5)).collect()
    want, digest = brute_clusters(rows)
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in got} == want and len(got) == len(rows)
    for r in got:
        assert r["centroid_sha256"] == digest[r["cluster"]]
        assert r["cluster_inertia"] == sum(d for c, d in want.values() if c == r["cluster"]) and r["inertia"] == sum(d for _, d in want.values())


def test_op13_odd_tables(spark):
    assert bisectors.op13_bisector_clusters(spark.createDataFrame([], VECTORS)).collect() == []
    same = [(i % 3, [1.0] * 64, None, *"abcd") for i in range(20)]
    got = bisectors.op13_bisector_clusters(spark.createDataFrame(same, VECTORS)).collect()
    assert len(got) == 20 and {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)}
    huge = [(i, [3e38 * (-1) ** i] * 64, None, *"abcd") for i in range(300)]
    got = bisectors.op13_bisector_clusters(spark.createDataFrame(huge, VECTORS)).collect()
    assert len(got) == 300 and all(r["distance"] == 0 for r in got)


def test_tournament_zero_favours_the_smaller_number():
    game = bisectors.Tournament(np.array([[4, 0], [0, 0], [4, 0], [8, 0]]))
    winner, distance = game.winners(np.array([[2, 0], [4, 1], [6, 0], [9, 9]]))
    assert winner.tolist() == [0, 0, 0, 3] and distance.tolist() == [4, 1, 4, 82]


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        lines = f.read()
    ranks = byte_bpe.parse_ranks(lines)
    return lines, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    near = "abcdeéüñßあ漢字한🎉 \n\t  '’sd12٣.,!?-_­ ​\x1c\x85"
    anything = lambda: chr(rng.choice([rng.randint(1, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(32, 126)]))
    return ["".join(rng.choice(near) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["".join(anything() for _ in range(rng.randint(0, 90))) for _ in range(n // 10)]


def test_op12_equals_the_library(spark, vocabulary):
    _, _, library = vocabulary
    rows = [(i, x, "k") for i, x in enumerate(odd_texts(400))] + [(None, "null id"), (7000, None), (7001, ""), (7001, ""), (7002, " " * 50), (7003, "<|endoftext|> ''s it's"), (7004, "ab" * 30_000)]
    rows = [(*r[:2], "k") for r in rows]
    got = byte_bpe.op12_byte_bpe(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)).collect()
    ids = lambda x: library.encode_ordinary(x or "")
    want = [(i, len(ids(x)), hashlib.sha256(np.array(ids(x), "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for i, x, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_transducer_forgets_and_stays_right(vocabulary):
    _, ranks, library = vocabulary
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    encoder.machine.most = 50  # states are thrown away all the time
    for x in odd_texts(300, seed=2) + ["antidisestablishmentarianism" * 9]:
        assert np.frombuffer(encoder.encode(x), "<u4").tolist() == library.encode_ordinary(x), repr(x)
    assert len(encoder.machine.states) <= 51


def test_transducer_on_ranks_that_merge_in_odd_orders():
    """Small vocabularies with tokens that merges don't reach, or reach by another way, against plain merging."""
    rng = random.Random(9)
    for _ in range(60):
        ranks = {bytes([b]): 1000 + b for b in range(256)}
        words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
        ranks |= {w: r for w, r in zip(words, rng.sample(range(1000), len(words)), strict=True)}
        library = tiktoken.Encoding("own", pat_str="[abc]+", mergeable_ranks=ranks, special_tokens={})
        machine = byte_bpe.Transducer(ranks)
        for _ in range(60):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 24)))
            assert np.frombuffer(machine.piece(data), "<u4").tolist() == library.encode_ordinary(data.decode()), (data, ranks)


def test_long_texts_are_cut_and_take_linear_time(vocabulary, monkeypatch):
    _, ranks, library = vocabulary
    monkeypatch.setattr(byte_bpe, "LONG", 16)
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for x in odd_texts(200, seed=5) + ["a  b \n c\n\n  d   e" * 20]:
        assert np.frombuffer(encoder.encode(x), "<u4").tolist() == library.encode_ordinary(x), repr(x)
    begun = time.time()
    encoder.machine.piece(b"abcdefgh" * 100_000)
    assert time.time() - begun < 20


def test_streaming_decoder_holds_back_unfinished_characters(vocabulary):
    _, ranks, library = vocabulary
    stream = byte_bpe.StreamDecoder({r: t for t, r in ranks.items()})
    for x in odd_texts(60, seed=7):
        ids, out = np.array(library.encode_ordinary(x), np.int64), []
        stream.reset()
        for i in range(0, len(ids), 3):
            out.append(stream.feed(ids[i : i + 3]))
            out[-1].decode()  # whole characters only
        assert b"".join(out) + stream.finish() == x.encode() and not stream.errors
    single = lambda data: np.array([ranks[bytes([b])] for b in data])
    for data, errors in ((b"\xff", 1), (b"\xe3\x81", 1), (b"\xc3\xc3\xa9", 1), (b"a\x80b", 1), (b"\xed\xa0\x80", 3), (b"\xe3a", 1), (b"\xf4\x8f\xbf\xbf", 0)):
        stream.reset()
        assert stream.feed(single(data)) + stream.finish() == data and stream.errors == errors, data


def test_decode_passes_other_columns(spark, vocabulary):
    lines, ranks, _ = vocabulary
    ids = np.array([ranks[b"\xe3"], ranks[b" the"]], "<u4").tobytes()
    got = byte_bpe.decode(spark.createDataFrame([(1, bytearray(ids), "x"), (2, None, "y")], "decoder long, ids binary, kept string"), lines).orderBy("decoder").collect()
    assert [(bytes(r["decoded"]), r["is_text"], r["kept"]) for r in got] == [(b"\xe3 the", False, "x"), (b"", True, "y")]


def test_round_trip_is_encode_and_decode(spark, vocabulary):
    lines, _, _ = vocabulary
    docs = spark.createDataFrame(list(enumerate([*odd_texts(60, seed=8), None])), "doc_id long, text string").repartition(2)
    both = byte_bpe.decode(byte_bpe.encode(docs, lines, public_tokenizers.PATTERN), lines)
    whole = byte_bpe.round_trip(docs, lines, public_tokenizers.PATTERN)
    columns = sorted(whole.columns)
    assert sorted(both.columns) == columns and sorted(map(str, both.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))


def test_vector_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    for name in ("op11_ball_codes", "op13_bisector_clusters"):
        got = queries.queries()[name](spark, folder)
        columns = sorted(got.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.select(*[F.col(c) for c in columns]).collect())) == sorted(want)
