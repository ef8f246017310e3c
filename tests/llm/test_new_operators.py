"""Conversation repair, piece encoding and whitening against brute force on small tables."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.llm import auction, pieces, whitening
from pitspark.llm.queries import piece_model_path


# conversation repair

def cheapest(codes):
    """(cost, letters) by dynamic programming over all edits, letters compared as strings."""
    behind = list(zip(auction.ENDING, auction.TAIL))
    for code in reversed(codes):
        after = []
        for state in range(4):
            ways = [(behind[state][0] + 3, "D" + behind[state][1])]
            if code != auction.MUST_GO:
                late, follower = code & 1, auction.FOLLOWER[state]
                ways.append((behind[follower][0] + 2 + late, "R" + behind[follower][1]))
                kept = auction.KEPT.get((state, "sua-"[code >> 1]))
                if kept is not None:
                    ways.append((behind[kept][0] + late, "K" + behind[kept][1]))
            after.append(min(ways))
        one = [auction.FOLLOWER[s] for s in range(4)]
        two = [auction.FOLLOWER[s] for s in one]
        behind = [min(after[s], (after[one[s]][0] + 2, "I" + after[one[s]][1]), (after[two[s]][0] + 4, "II" + after[two[s]][1])) for s in range(4)]
    return behind[0]


def brute_repair(turns):
    """The contract's figures of one conversation, turns in order, without the operator's code for faults and lines."""
    seen, faults, codes = [], [], []
    for _, role, text in turns:
        shown = text.strip(" \t\n\r\x0b\x0c")
        kind = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else ""
        seen.append((role, text))
        faults.append(kind)
        codes.append(8 if kind in ("b", "d") else 2 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + (kind == "t"))
    cost, audit = cheapest(codes)
    lines, at = [], 0
    for letter in audit:
        follower = "assistant" if lines and lines[-1][0] == "u" else "user"
        if letter == "K":
            lines.append((turns[at][1][0], f"{turns[at][1]}:{turns[at][2]}"))
        elif letter == "R":
            lines.append((follower[0], f"{follower}:{turns[at][2]}"))
        elif letter == "I":
            lines.append((follower[0], follower + ":"))
        at += letter != "I"
    assert at == len(turns)
    starts = "".join(s for s, _ in lines)
    assert starts in ("",) or (starts.removeprefix("s") == "ua" * (len(starts) // 2) and len(starts) > 1)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(line for _, line in lines).encode()).hexdigest())


def test_auction_finds_the_first_of_the_cheapest_repairs():
    rng = random.Random(1)
    for _ in range(600):
        codes = bytes(rng.choice([0, 2, 4, 2, 4, 3, 5, 6, 8]) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 16, 17, 33, 70])))
        assert auction.solve(codes) == cheapest(codes), list(codes)


def test_prices_stay_under_every_arc():
    layers = [auction.ARCS[c] for c in (2, 4, 3, 8, 5)]
    price = [0] * (4 * len(layers) + 4)
    auction.auction(layers, auction.ENDING, price, 0)
    for node in range(4 * len(layers)):
        assert all(price[node] <= cost + price[node + step] for step, cost, _ in layers[node >> 2][node & 3])


def chats():
    rng = random.Random(3)
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "ünïte", "Üser"]
    texts = ["Hello there.", "ok", None, "", " \t\n", "Yes!", "No? ", "é…", "\x1c", "a.\nb"]
    rows = []
    for conv, n in ((None, 4), (1, 700), (2, 1), (3, 40), (4, 6)):
        rows += [(conv, rng.choice([None, i, i, i, i, max(0, i - 1)]), rng.choice(roles), rng.choice([*texts, f"x y z {i}.", f"x {i}?", f"q {i // 2}."])) for i in range(n)]
    return rows + [(6, 0, "user", "a.")] + [(7, 1, "user", "dup.")] * 60 + [(8, 1, "user", "long " * 20_000 + "."), (8, 2, "assistant", "x" * 90_000)]


def in_order(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(t, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode())) for c, t in by.items()}


@pytest.mark.parametrize("partitions,held", [(1, 1 << 22), (3, 1 << 22), (13, 400)])
def test_repair_equals_brute_force(spark, monkeypatch, partitions, held):
    monkeypatch.setattr(auction, "HELD", held)
    rows = chats()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, part int").repartition(4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = auction.repair(table).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = in_order(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == brute_repair(want[r["id"]]), r["id"]


def test_damage_and_conversations_that_lose_all_turns(spark):
    rows = [(c, t, "assistant", f"A {t}. B!") for c in range(60) for t in range(3)] + [(None, None, None, None), (None, 5, "user", "x.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want, left = [], []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.replace(".", "").replace("!", "").replace("?", "") if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    damaged = auction.damage(table)
    key = lambda r: str(r)
    assert sorted((tuple(r)[:4] for r in damaged.where("live").collect()), key=key) == sorted(want, key=key)
    one = next((c, t) for c in range(60) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    alone = table.where((F.col("conv_id") == one[0]) & (F.col("turn") == one[1]))
    assert [tuple(r) for r in auction.repair(auction.damage(alone), "id", live=F.col("live")).collect()] == [(one[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert auction.repair(table.limit(0)).collect() == []


# piece encoding

ODD = [None, "", " ", "  a", "▁", "a▁b", "\n", " \n ", "é", "😀😀 x", "<s>", "<0x0A>", "\x00a", "a\tb  c", "²..", "日本語テキスト", "  lead", "trail  ", " x", "x" * 5000, "\x1c",
       "İi", "한국어", "�", "１２ 34", " ▁ ▁x", "don't (stop)", "a" * 70 + "!" * 70]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def test_encoding_equals_the_library(spark, folder, library):
    texts = [(i, t, 7, "taken") for i, t in enumerate(ODD + ODD[:3])]
    texts += [(100 + r["doc_id"], r["text"], 0, "x") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    table = spark.createDataFrame(texts, "doc_id long, text string, n int, ids string").repartition(3)
    rows = pieces.encode(table, piece_model_path()).collect()
    assert len(rows) == len(texts) and rows[0].__fields__ == ["doc_id", "text", "n", "ids", "decoded"]
    for r in rows:
        ids = library.encode(r["text"] or "")
        assert list(r["ids"]) == ids and r["decoded"] == library.decode(ids), r["text"]
    assert pieces.encode(table.limit(0), piece_model_path()).collect() == []


@pytest.mark.parametrize("at_once", [1, 7, 60])
def test_long_texts_are_put_together_from_parts(monkeypatch, library, at_once):
    monkeypatch.setattr(pieces, "UNITS_AT_ONCE", at_once)
    memory = pieces.Memory(pieces.Vocabulary(piece_model_path()), most=50)
    text = " ".join(t for t in ODD if t) * 5
    parts = list(memory.parts(text))
    memory.check()
    ids = np.concatenate(parts).tolist()
    assert len(parts) > 1 and ids == library.encode(text) and memory.decode(parts) == library.decode(ids)


def test_a_difference_to_the_library_stops_the_job():
    memory = pieces.Memory(pieces.Vocabulary(piece_model_path()))
    memory.fresh.append(("▁the", memory.vocabulary.alone("▁of")))
    with pytest.raises(ValueError):
        memory.check()


# whitening

def matrices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 40, 90):
        a = rng.standard_normal((n, n))
        q, _ = np.linalg.qr(a)
        yield a @ a.T
        yield np.eye(n) * 3
        yield (q * np.r_[np.full(min(4, n), 7.0), np.full(n - min(4, n), 2.0)]) @ q.T
        yield np.outer(a[0], a[0])
        yield np.diag(np.repeat([5.0, 5, 1], n)[:n])
        yield np.ones((n, n))
        yield a @ np.diag(10.0 ** -np.arange(n)) @ a.T


@pytest.mark.parametrize("matrix", list(matrices()), ids=lambda m: str(len(m)))
def test_leading_components_against_the_dense_solver(matrix):
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_components(matrix, 8)
    want = np.linalg.eigvalsh(matrix)[::-1][:8]
    assert np.abs(values - want).max() <= 1e-13 * abs(want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-13
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * abs(want[0])


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(base)] + [(5, base[5].tolist(), "x", 1)]
    odd = [(900, None, "x", 1), (901, [1.0] * 11 + [None], "x", 1), (902, [float("nan")] * 12, "x", 1), (903, [float("inf")] + [0.0] * 11, "x", 1), (904, [], "x", 1), (905, [1.0] * 5, "x", 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n string, component int").repartition(5)
    got = whitening.whiten(table).orderBy("vec_id", "component").toPandas()
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v, *_ in sorted(rows, key=lambda r: r[0])], object)
    n, total = len(x), x.sum(0)
    centred = (x * n - total).astype(float) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    want = np.abs(centred @ vectors / np.sqrt(values))
    assert len(got) == 8 * n and set(got["n"]) == {n}
    one = got.drop_duplicates(["vec_id", "component"])["whitened"].to_numpy().reshape(-1, 8)
    once = np.abs(want)[[i for i, r in enumerate(sorted(rows, key=lambda r: r[0])) if i == 0 or sorted(rows, key=lambda r: r[0])[i - 1][0] != r[0]]]
    assert np.abs(np.abs(one) - once).max() < 1e-9
    assert np.abs(got["explained"].to_numpy()[:8] - values / np.trace(v)).max() < 1e-12
    assert got["deviation"].tolist() == [int(d) for d in ((n * x - total) ** 2).sum(1) for _ in range(8)]
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in line) == [(1, 1), (2, 1), (3, 1)] and abs(line[0]["explained"] - 1) < 1e-12


def test_covariance_and_deviation_are_exact_for_large_entries():
    x = np.array([[2**51, -5], [3, 2**51 - 1], [7, 7]], np.int64)
    total = x.astype(object).sum(0)
    assert whitening.products(x).tolist() == x.astype(object).T.dot(x.astype(object)).tolist()
    assert whitening.deviations(x, 3, total) == [None, None, None]
    assert whitening.deviations(np.array([[1, 2], [4, 8]]), 2, np.array([5, 10], object)) == [(2 - 5) ** 2 + (4 - 10) ** 2, (8 - 5) ** 2 + (16 - 10) ** 2]
