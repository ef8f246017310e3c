"""The text operators against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""
import html as html_lib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitspark.llm import chat, forest, language, minhash, mixing, ngram_lm, packing, sitestyle, suffixes, topk
from pitspark.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, size int, kept string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = make(120), make(60)
    near = base.split()
    near[7], near[90] = "X", "Y"
    rows = [make(rng.randint(60, 200)) for _ in range(12)]
    rows += [base, base, " ".join(near), base.upper(), make(30) + " " + passage + " " + make(30), make(80) + "\n" + passage, passage]
    rows += [None, "", "  \t ", "one two", "one two", "ONE two", "a " * 3000, "é ñ <|endoftext|> x\x1cy 0 007 don't İ", make(49), make(50)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    sources = ["b", None, "a", "é"]
    rows = [(i, t, ["en", None, "fr"][i % 3], sources[i % 7 % 4], 1, "no") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[3], (None, "alone here", None, "z", 0, None)], DOCS).repartition(3)


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_of(nodes, linked):
    root = {n: n for n in nodes}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_packing_is_an_exact_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.harmonic_pack(docs, tokenizer_path()).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        ids = np.array(tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        times = sum(p["length"] for p in pieces) // (len(ids) // 4)
        assert times == (2 if doc == 3 else 1) and all(p["doc_tokens"] * 4 == len(ids) for p in pieces)
        for p in pieces:
            assert bytes(p["ids"]) == ids[p["start"] * 4:(p["start"] + p["length"]) * 4]
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert set(by_doc) == set(texts)


def test_cut_plan_covers_every_length():
    for n in range(2048):
        plan = packing.cut_plan(n, 2048, 1 / 64)
        assert sum(s for s, _ in plan) == n and all(s * k <= 2048 and s * k >= 2048 - 64 for s, k in plan)


def test_mixing_meets_budgets(docs):
    rows = mixing.mix(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes.setdefault(r["source"], []).append(len(WORD.findall(r["text"] or "")))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    total, weight = sum(map(sum, sizes.values())), {s: 1 + i % 3 for i, s in enumerate(order)}
    stopped = set()
    while True:
        left = total - sum(3 * sum(sizes[s]) for s in stopped)
        free = sum(weight[s] for s in order if s not in stopped)
        target = {s: 3 * sum(sizes[s]) if s in stopped else left * weight[s] / free for s in order}
        more = {s for s in order if target[s] > 3 * sum(sizes[s])}
        if not more:
            break
        stopped |= more
    taken = {}
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(sizes[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_near_duplicates_equal_brute_force(docs, texts):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    expected = components_of(list(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), expected[r["doc_id"]], expected[r["doc_id"]] == r["doc_id"])


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for percent, apart in ((80, 10), (85, 8)):  # 80 of 100 and 84 of 100 common shingles
        sign, missed = minhash.Signer(minhash.bands_of(percent)), 0
        for _ in range(3000):
            x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
            missed += not (sign(x[apart:])[0] == sign(x[:-apart])[0]).any()
        assert missed <= 1


def test_groups_whose_members_differ_from_the_lead(spark):
    """Edits of one text: many pairs around the threshold, several rounds of comparison."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    expected = components_of(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_rows_of_one_id_are_compared_by_their_own_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "z " + b), (5, None), (None, a)]
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [(1, 196, 1, True), (1, 196, 1, True), (2, 197, 1, False), (3, 197, 1, False), (4, 197, 1, False), (5, 0, 5, True), (None, 196, None, True)]))
    with pytest.raises(ValueError):
        minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=70)


def test_block_links_are_a_forest_over_all_confirmed_pairs():
    import pandas as pd

    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**62, 300)).astype(np.uint64)
    members, sign = [], minhash.Signer(minhash.bands_of(85))
    for k in range(70):
        own = base.copy()
        own[rng.choice(len(own), rng.integers(0, 40), replace=False)] = rng.integers(0, 2**62, 1)[0] + np.arange(1, dtype=np.uint64)
        own = np.unique(own)
        bands, sketch = sign(own)
        members.append((bytes([k]) * 16, own, len(own), bands, sketch))
    key = -1  # shared by no band, so that no pair is left to an earlier one
    block = pd.DataFrame([{"key": key, "rep": r, "label": members[k // 2 * 2][0], "n": n, "sketch": sk, "bands": b, "shingles": s.view(np.int64), "block": k % 2, "bi": 0, "bj": 1}
                          for k, (r, s, n, b, sk) in enumerate(members)])
    links = minhash.block_links(block, 85)
    assert len(links) < 35 and set(links.columns) == {"a", "b"}
    by = {r: set(s.tolist()) for r, s, *_ in members}
    alike = lambda a, b: 100 * len(by[a] & by[b]) >= 85 * len(by[a] | by[b])
    assert all(alike(a, b) for a, b in zip(links["a"], links["b"]))
    label, names = {m[0]: members[k // 2 * 2][0] for k, m in enumerate(members)}, [m[0] for m in members]
    bands = {m[0]: set(m[3].tolist()) for m in members}
    joined = components_of(sorted(set(label.values())), lambda u, v: any({label[a], label[b]} == {u, v} for a, b in zip(links["a"], links["b"])))
    # every pair between the blocks that the operator may link is joined (pairs that share a band are another group's)
    wanted = components_of(sorted(set(label.values())), lambda u, v: any(
        {label[names[i]], label[names[j]]} == {u, v} and alike(names[i], names[j]) and not bands[names[i]] & bands[names[j]] for i in range(0, 70, 2) for j in range(1, 70, 2)))
    assert joined == wanted


def expected_spans(texts, n=50):
    where, words = {}, {i: WORD.findall(t or "") for i, t in enumerate(texts)}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i:i + n]), set()).add(d)
    out = set()
    for d, w in words.items():
        for later in (False, True):
            starts = [i for i in range(len(w) - n + 1) if len(where[tuple(w[i:i + n])]) > 1 and (min(where[tuple(w[i:i + n])]) < d) == later]
            for i, s in enumerate(starts):
                if not i or s - starts[i - 1] > n:
                    begin = s
                if i + 1 == len(starts) or starts[i + 1] - s > n:
                    out.add((d, begin, s + n - begin, later))
    return out


def test_repeated_passages_equal_brute_force(docs, texts):
    rows = suffixes.repeated_passages(docs).collect()
    assert {tuple(r) for r in rows} == expected_spans(texts) and len(rows) == len({tuple(r) for r in rows})


def test_cut_repeats_keeps_the_first_holder(docs, texts):
    left = suffixes.cut_repeats(docs, suffixes.repeated_passages(docs))
    assert left.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in left.collect()}
    for d, text in enumerate(texts):
        gone = {w for s, n, later in (x[1:] for x in expected_spans(texts) if x[0] == d) if later for w in range(s, s + n)}
        kept = [w for i, w in enumerate(WORD.findall(text or "")) if i not in gone]
        if gone and not kept:
            assert d not in rows
        else:
            assert WORD.findall(rows[d] or "") == kept and (gone or rows[d] == text)


def test_backoff_scores_equal_plain_counts(docs):
    rows = docs.collect()
    grams = {}
    for r in rows:
        w = WORD.findall(r["text"] or "")
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                grams[tuple(w[i:i + n])] = grams.get(tuple(w[i:i + n]), 0) + 1
    total = sum(c for g, c in grams.items() if len(g) == 1)

    def value(w):
        out = 0.0
        for i in range(len(w)):
            for n in range(min(3, i + 1), 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if n == 1 or grams[g] >= 2:
                    out += np.log(grams[g] / (grams[g[:-1]] if n > 1 else total)) + (min(3, i + 1) - n) * np.log(0.4)
                    break
        return out

    expected = sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(value(WORD.findall(r["text"] or "")), 6)) for r in rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(r["log_score"], 6)) for r in ngram_lm.score(docs).collect())
    assert [g[0] for g in got] == [e[0] for e in expected] and np.allclose([g[1] for g in got], [e[1] for e in expected], atol=1e-5)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    x[300:360] = x[5] + 0.12 * rng.standard_normal((60, 16))
    x[400:420] = x[7]
    x[420] = 2 * x[7]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1), (905, [float("inf")] + [1.0] * 15, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), x


def test_forest_finds_the_links(vectors):
    df, x = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    rows = {r["vec_id"]: r for r in forest.near_vectors(df).collect()}
    assert len(rows) == 906 and all(rows[i]["n_links"] == 0 and rows[i]["component_id"] == i for i in range(900, 906))
    found = np.array([rows[i]["n_links"] for i in range(900)])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum() and near.sum() > 400


def test_topk_equals_brute_force(vectors):
    df, x = vectors
    q = topk.quantised(df)
    assert q.count() == 902  # the zero and the empty vector are usable
    v = np.vstack([np.floor(256 * x), np.zeros((1, 16))]).astype(np.int64)
    ids = list(range(900)) + [901]
    got = {}
    for r in topk.exact_topk(q, q.where("vec_id % 50 = 0 OR vec_id = 901"), 5, candidate_block=128, query_block=8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for ask, row in zip(ids, v):
        if ask % 50 == 0 or ask == 901:
            best = sorted(((-int(s), i) for i, s in zip(ids, v @ row) if i != ask))[:5]
            assert [got[ask][k + 1] for k in range(5)] == [(i, -s) for s, i in best]


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/x">X</a></ul></nav>
<div class="cookie-notice">ok?</div><article><h1>Head  &amp; line</h1><p>One <b>two</b>
 three<p>Four&nbsp;&eacute;<br>five</p><div class="share">Share</div><form><input>go</form><section id="comments"><p>nice!</p></section></article><aside class="sidebar">S</aside><footer>F</footer>"""


def test_main_text(spark):
    rows = [(1, "http://h.x/1", PAGE), (2, "http://h.x/2", None), (3, None, ""), (4, "http://h.x/4", "<p>plain<p>text &lt;b&gt;"), (4, "http://h.x/4", "<p>plain<p>text &lt;b&gt;"), (5, "bad", "<nav>only</nav>")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in sitestyle.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    whole = "Head & line\nOne two three\nFour é\nfive"
    assert got == [(1, whole, len(whole)), (2, "", 0), (3, "", 0), (4, "plain\ntext <b>", 14), (4, "plain\ntext <b>", 14), (5, "", 0)]


@pytest.mark.parametrize("before", [
    "<script>for(i=0;i<n;i++){f(i)}</script>", "<script>if (a <b && c == \"'\") x()</SCRIPT >", "<script><!-- hide\nf()</script>", "<style>/* <!-- */</style>",
    "<textarea>1 <b</textarea>", "<svg viewBox='0 0 1 1'/>", "<math display='block' />", "<svg><path d='M0'/>", "<canvas width=1>", "<object data='x'><p>", "<template><b>",
    "<noscript>", "<iframe src='x'>", "<object><object></object>no</object>", "<svg><style>a</style><script>'</svg>' <q</script><text>no</text></svg>", "<!-- <svg> --><svg><g></g></svg>",
])
def test_raw_elements_never_swallow_the_article(before):
    page = f"<html><body>{before}<article><p>Kept.</p><svg><text>no</text></svg></article></body></html>"
    assert sitestyle.main_text(page, frozenset()) == "Kept."


def test_style_tree_removes_a_block_that_all_pages_share(spark):
    page = lambda i: f"<body><article><div class='tools'><p>Print this page</p></div><p>Story number {i} is new.</p></article></body>"
    rows = [(i, f"http://news.x/{i}", page(i)) for i in range(60)]
    got = {r["page_id"]: r["text"] for r in sitestyle.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story number {i} is new." for i in range(60)}


def test_chat_repair_is_cheapest(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "Human ", "tool", None]), f"t{t}"))
    rows += [(None, 1, "assistant", None), (99, None, "user", "x"), (99, None, "user", "x")] + [(100, i, "user", str(i)) for i in range(400)]
    out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {}
    for r in out:
        by.setdefault(r["conv_id"], []).append(r)
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        roles = [chat.ROLES.index(x) if x in chat.ROLES else (1 if x == "human" else -1) for x in ((r[2] or "").strip().lower() for r in turns)]
        mine = sorted(by[conv], key=lambda r: (r["position"], r["piece"]))
        if len(roles) <= 6:
            best = min(sum(chat.STEPS[a][b, s] for a, b, s in zip(roles, (chat.START, *q), q)) + chat.FINAL[q[-1]] for q in itertools.product(range(3), repeat=len(roles)))
            assert abs(sum(r["cost"] for r in mine) - best) < 1e-9
        shown = "".join(r["rendered"] for r in mine)
        heads = re.findall(r"<\|im_start\|>(\w+)\n", shown)
        assert shown.count("<|im_end|>") == len(heads) and re.fullmatch("(system )?(user assistant )+", " ".join(heads) + " ")
        assert sum(r["action"] != "insert" for r in mine) == len(turns)


def test_language_is_learned_from_text_alone(spark):
    rng = random.Random(1)
    parts = {"aa": ["lo", "mi", "ra"], "bb": ["sch", "ung", "eit"], "cc": ["çé", "où", "eau"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(20))
    rows = [(i, make(lang), lang) for i in range(200) for lang in [list(parts)[i % 3]]] + [(300, None, "aa"), (301, "12 34 !", "bb"), (302, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where(~language.held_out()), sample=90, landmarks=30)
    got = {r["doc_id"]: r for r in language.predict(df, model).withColumn("h", language.held_out()).collect()}
    assert all(got[i]["h"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows[:200])
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (300, 301, 302))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = topk.quantised(vectors)
    model = language.fit(docs)
    for df in (packing.harmonic_pack(docs, tokenizer_path()), mixing.mix(docs), minhash.near_duplicates(docs), suffixes.repeated_passages(docs), ngram_lm.score(docs),
               sitestyle.extract(pages), chat.repair(turns), forest.near_vectors(vectors), topk.exact_topk(q, q), language.predict(docs, model)):
        assert df.count() == 0


def test_pipeline_stages(spark, docs, texts, tmp_path):
    import corpus_pipeline as pipeline

    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    kept, docs = docs, spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, path).cache()
        assert kept.columns == docs.columns, name
        if name == "minhash_near_dedup":
            ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
            sets = {i: shingles(texts[i]) for i in {r["doc_id"] for r in before.collect()} - {None}}
            groups = components_of(list(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
            assert sorted(ids) == sorted(set(groups.values()))
        if name == "language_id":
            assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in kept.collect()} <= {i for i, t in enumerate(texts) if not re.search(r"[^\W\d_]", t or "")}
    assert pipeline.run(spark, path).count() > 0


def test_unclaimed_texts_leave_the_pipeline(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(2)
    syllables = {"en": "the ing and er ion of th re ou sh", "de": "der sch ung ein ich und zu keit pf ver", "fr": "eau oi qué ment ré la çon ai eux tre", "es": "ción os ñar que el ía rro do ue ll",
                 "ru": "ст но ли при ка ват ого жи щь ет", "fi": "kk yy äm ssa juv pöl ppi hta mme vät"}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(60))
    junk = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60))
    known = [(i, make(lang), lang) for i in range(600) for lang in [("en", "de", "fr", "es")[i % 4]]]
    strange = [(1000 + i, [make("ru"), make("fi"), junk()][i % 3], None) for i in range(60)]
    docs = spark.createDataFrame(known + strange, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in pipeline.known_language(spark, docs, "").collect()}
    held = {i for i, *_ in known if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(held) >= pipeline.LEAST_KNOWN and held <= kept and kept <= {i for i, *_ in known}


def test_shared_smaller_leaves_match_sets():
    rng = np.random.default_rng(1)
    leaves = [list(rng.choice(60, 12, replace=False) * 7) for _ in range(50)] + [[]]
    i, j = np.triu_indices(len(leaves), 1)
    for leaf in (0, 70, 350, 10**6):
        want = [any(c < leaf for c in set(leaves[a]) & set(leaves[b])) for a, b in zip(i, j)]
        assert forest.share_smaller(leaves, leaf, i, j).tolist() == want
    assert len(forest.share_smaller(leaves, 70, i[:0], j[:0])) == 0


def test_backoff_texts_hashes_and_totals_are_packed_closely():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 1 << 63, 14_000, dtype=np.uint64)) >> np.uint64(6)  # a hash partition's share of a block
    totals = np.where(rng.random(14_000) < 0.08, rng.integers(2, 1 << 40, 14_000), 1).astype(np.uint64)
    gaps = np.diff(keys, prepend=np.uint64(0))
    packed = ngram_lm._pack(gaps)
    assert (ngram_lm._unpack(packed, np.uint64) == gaps).all() and len(packed) < 6 * len(keys)
    packed = ngram_lm._pack_totals(totals)
    assert (ngram_lm._unpack_totals(packed) == totals).all() and len(packed) < len(totals)
    for n in (0, 1, 9):
        for values in (np.zeros(n, np.uint64), np.ones(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)):
            assert (ngram_lm._unpack(ngram_lm._pack(values), np.uint64) == values).all()
            assert (ngram_lm._unpack_totals(ngram_lm._pack_totals(np.maximum(values, 1))) == np.maximum(values, 1)).all()
    for text in (None, "", "a", "é\x85 日本\x1c\t", "word " * 900):
        assert ngram_lm._text(ngram_lm._packed_text(text)) == (text or None)
    assert len(ngram_lm._packed_text("word " * 900)) < 100


def test_backoff_hashes_of_a_block_do_not_cross_documents():
    texts = ["a b c", None, "d", "", "e f"]
    levels, lengths = ngram_lm.block_hashes(pd.Series(texts), 3)
    alone = [ngram_lm.block_hashes(pd.Series([t]), 3)[0] for t in texts]
    assert lengths == [3, 0, 1, 0, 2] and [len(x) for x in levels] == [6, 3, 1]
    assert all((x == np.concatenate([a[n] for a in alone])).all() for n, x in enumerate(levels))
