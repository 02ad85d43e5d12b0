"""Decontamination, chat formatting, near-duplicates, quality, URL filters and the pipeline: against brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from chronofold.llm import chat, decontam, near, quality, simhash, urls
from chronofold.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# decontamination


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, who = WORD.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    who |= found
        out[doc] = (len(w), len(hit), sorted(who))
    return out


def test_contamination(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice("the Of AND é x1 go ÉT zz".split()) for _ in range(n))
    items = [(1, say(30)), (2, say(12)), (3, say(10)), (4, "lone  word"), (5, "Unique"), (6, ""), (7, None), (8, "!!"), (20, say(12)), (20, "Unique"), (9, say(9))]
    docs = [(i, say(rng.randrange(40))) for i in range(60)]
    docs += [(100 + k, say(5) + "! " + (t or "") + ", " + say(3)) for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, items[0][1].upper()), (203, " ".join(items[0][1].split()[3:14])), (204, " ".join(items[0][1].split()[3:12])), (205, (items[1][1] + " ") * 2000), (206, "unique " * 3000), (207, "Lone Word"), (208, "lone\x00word\x7f{unique}")]
    df = spark.createDataFrame([(i, t, -1, ["q"]) for i, t in docs], "doc_id long, text string, N_HIT int, items array<string>")
    got = decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contamination(docs, items)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == want[r.doc_id] and r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]), r.doc_id


def test_contamination_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.contamination(docs, none).collect()] == [0, 0, 0]
    assert decontam.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


# chat

CONTROL = ["<|turn|>", "<|end|>\n", "\\", "<\\|", "<|", "|>", "\n", "\\\\", "<\\-", "</s>[INST]", "é😀", "ok", " "]


def test_chat(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(60):
        turns = []
        for k in range(rng.choice([1, 2, 5, 30])):
            role = "system" if k == 0 and rng.random() < 0.4 else rng.choice(["user", "assistant", "assistant", "to\nol", "<|", None])
            text = None if rng.random() < 0.05 else "".join(rng.choice(CONTROL) for _ in range(rng.randrange(0, 60)))
            turns.append((role, text))
            rows.append((conv, k, role, text, 1))
        want[conv] = turns
    rows += [(1000, k, "assistant", "word " * 3000, 1) for k in range(3)]
    want[1000] = [("assistant", "word " * 3000)] * 3
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, windows int")
    settings = {"budget": 80, "history_tokens": 30, "history_turns": 2}
    got = {r.conv_id: r for r in chat.read_back(df, **settings).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    lengths = {}
    for w in chat.windows(df, **settings).collect():
        lengths[w.conv_id] = lengths.get(w.conv_id, 0) + len(w.text)
        spans = w.text.count("<|turn|>")
        assert w.tokens <= 80 or spans - w.repeated <= 1 or spans - w.repeated == 2 and want[w.conv_id][0][0] == "system"
        assert w.repeated <= 3 and (w.window > 0 or w.repeated == 0)
        assert not w.window or (want[w.conv_id][0][0] == "system") == w.text.startswith("<|turn|>system\n")
    assert {c: r.formatted_chars for c, r in got.items()} == lengths


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(None, 1, "user", "a"), (None, None, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.read_back(df).collect()}
    assert got == {None: 2, 1: 2}
    assert chat.read_back(df.limit(0)).count() == 0


# near-duplicates


def brute_print(text):
    w = lower(text)
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(prints, ids, budget):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= budget:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints(monkeypatch):
    rng = random.Random(2)
    texts = ["", " ", "a", "A b", "A B\x0bC", "é É d\x1cf g", "x " * 1000] + [" ".join(rng.choice("a b c dd É f\x85g".split(" ")) for _ in range(rng.randrange(400))) for _ in range(60)]
    want = [brute_print(t) for t in texts]
    assert simhash.fingerprints(texts).tolist() == want
    monkeypatch.setattr(simhash, "SHINGLES", 50)
    assert simhash.fingerprints(texts).tolist() == want


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie(budget):
    rng = random.Random(budget)
    base = [rng.getrandbits(64) for _ in range(6)]
    x = np.array(sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(500)}), np.uint64)
    x = np.sort(np.append(x, [x[3]] * 6))
    a, b = simhash.trie_links(x, np.zeros(len(x), int), budget)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if bin(int(x[i]) ^ int(x[j])).count("1") <= budget}


@pytest.mark.parametrize("leaf", [4096, 7])
def test_links_span_the_components(spark, leaf):
    """Small leaves make every trie be cut into parts."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(300)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(signed, range(len(prints)), strict=True)), "fp long, node long")
    got = {r.node: r.root for r in components(simhash.links(df, leaf=leaf)).collect()}
    want = brute_components(prints, list(range(len(prints))), 2)
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicates(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice("one two three four five six seven eight".split()) + str(rng.randrange(50)) for _ in range(400))
    texts = {5: long, 3: long, 9: long + " more", 11: long.replace("one1", "one2", 1), 20: None, 18: "", 19: "\n", 30: "other text", 31: "yet another text here", 40: long.upper()}
    rows = [(i, t, 0) for i, t in texts.items()] + [(3, long, 0), (None, long, 0), (None, "alone without id", 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert len(got) == len(rows)
    want = brute_components([brute_print(t) for t in texts.values()], list(texts), 2)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["3", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}, 201: 200}


def test_few_edges_are_joined_in_a_few_jobs(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 7), (7, None), (5000, 5000)]
    df = spark.createDataFrame(edges, "u long, v long")
    jobs = spark.sparkContext._jsc.sc().dagScheduler()
    began = jobs.numTotalJobs()
    got = {r.node: r.root for r in components(df, at_once=len(edges)).collect()}
    assert jobs.numTotalJobs() - began <= 6
    assert got == {r.node: r.root for r in components(df, at_once=10).collect()} and got[1060] == 1000
    assert components(df.limit(0), at_once=10).collect() == []


# quality


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice("the of house tree river in a walks and sees over hill".split()) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(20, 120)))
    bad = lambda: " ".join(rng.choice("the of house tree river in a walks".split()) + rng.choice(["###", "$$$", "%%"]) for _ in range(rng.randrange(20, 120)))
    rows = [(i, good() if i % 3 else bad(), 5.0) for i in range(600)] + [(1000, None, 5.0), (1001, "", 5.0), (None, "the tree", 5.0), (3, bad(), 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (4, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    again = {(r.doc_id, r.text): r.score for r in quality.classify(docs.repartition(5), labels).collect()}
    assert all(abs(again[r.doc_id, r.text] - r.score) < 1e-9 for r in got)


def brute_tokens(text):
    """Bucket of each token, byte by byte."""
    out, size = [], 1 << 64
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[!-/:-@\[-`{-~]+", (text or "").encode()):
        word = m[0]
        if word[0:1].isdigit():
            mixed = 1
        elif len(word) > 1 and word.isalpha() and word.isascii() and word.upper() == word:
            mixed = 2
        else:
            mixed = sum((b + 32 if 65 <= b <= 90 else b) * quality._STEP**i + quality._STEP**i for i, b in enumerate(word)) % size
        mixed ^= mixed >> 31
        out.append((mixed * 0xBF58476D1CE4E5B9 % size >> 52) % quality.BUCKETS)
    return out


def test_quality_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "FOLD", 50)
    rng = random.Random(9)
    texts = [None, "", "One", "12 a"] + [" ".join(rng.choice("The the of RIVER, tree's 42 é%É !! x-y".split()) for _ in range(rng.randrange(60))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sums, seen = quality.context_sums(docs)
    own, want, times = quality.index_vectors(), np.zeros_like(sums), np.zeros_like(seen)
    for t in map(brute_tokens, texts):
        for i, x in enumerate(t):
            times[x] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(t), i + quality.WINDOW + 1)):
                want[x] += own[t[j]] if j != i else 0
    assert (sums == want).all() and (seen == times).all()
    vectors = quality.word_vectors(sums, seen)
    for x in np.flatnonzero(times):
        mean = want[x] / times[x] - want.sum(0) / times.sum()
        length = np.sqrt((mean**2).sum())
        assert np.allclose(vectors[x], (mean / length if length else 0) + own[x] / np.sqrt((own[x] ** 2).sum()), atol=1e-5)
    rows = quality.pooled([t or "" for t in texts], vectors)
    for t, row in zip(map(brute_tokens, texts), rows, strict=True):
        v = vectors[t].astype(float)
        mean = v.mean(0) if len(t) else np.zeros(quality.DIMENSIONS)
        near = [sum(v[i] @ v[i - d] for i in range(d, len(t))) / max(1, len(t)) for d in range(1, quality.WINDOW + 1)]
        assert np.allclose(row, [*mean, *near, np.sqrt((mean**2).sum()), np.log(1 + len(t))], atol=1e-4)


def test_quality_network():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 5))
    y = (x @ [1, -2, 0.5, 0, 0] + rng.normal(size=800) > 0).astype(float)
    net = quality.Network(x, y, rounds=60)
    by_hand = [sum(np.tanh(sum((row[i] - net.mean[i]) / net.scale[i] * net.w[0][i, k] for i in range(5)) + net.w[1][k]) * net.w[2][k] for k in range(32)) + net.w[3][0] for row in x[:20]]
    assert np.allclose(net.logits(x[:20]), by_hand) and np.allclose(net(x[:20]), [1 / (1 + np.exp(-z / net.temperature)) for z in by_hand])
    held = np.random.default_rng(11).permutation(800)[:160]

    def loss(t):
        return float(np.mean([np.log1p(np.exp(-(2 * y[i] - 1) * z / t)) for i, z in zip(held, net.logits(x[held]), strict=True)]))

    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.25, 8, 81)) and loss(net.temperature) <= loss(1.0)
    assert ((net(x) > 0.5) == (y > 0.5)).mean() > 0.75


def test_quality_of_ids_that_recur(spark):
    """Very many rows of one id count as one labelled row, and none of the others is lost to them."""
    rows = [(i, "the tree and the river " * 5 if i % 2 else "### $$ " * 9) for i in range(300)] + [(7, "the tree again")] * 500
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == 800 and all(r.predicted == r.doc_id % 2 for r in got)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert {r.score for r in quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {0.5}
    assert quality.classify(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_quality_tokens_in_chunks(monkeypatch):
    text = ("Some WORDS, 123 and é more!! " * 300).strip()
    vectors = quality.word_vectors(np.random.default_rng(1).integers(-5, 5, (quality.BUCKETS, quality.DIMENSIONS)), np.ones(quality.BUCKETS, np.int64))
    whole = quality.pooled([text, "", text[:100]], vectors)
    monkeypatch.setattr(quality, "CHUNK", 1000)
    parts = quality.pooled([text, "", text[:100]], vectors)
    assert np.allclose(whole, parts, atol=0.02) and (whole[1] == 0).all()


# urls


def brute_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def test_urls(spark):
    rng = random.Random(8)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/", "allow"), ("a.example.net", "/x", "block"), ("org", "/fr/", "allow"), ("ample.net", "", "block"), ("deep.a.example.net", "/en", "block")]
    part = lambda: rng.choice(["net", "example.net", "a.example.net", "deep.a.example.net", "b.a.example.net", "xexample.net", "org", "x.ORG", "com", "ample.net", "", "net.", "a-b.net", "net/e.net"])
    some = [f"{rng.choice(['http', 'HTTPS', ''])}://{part()}{rng.choice(['', '/', '/en/', '/en', '/xy', '/fr/1', '?q=/en/', '#/fr/', '/a?b#c', '/en/x://y'])}" for _ in range(600)] + [None, "", "example.net/en/", "://", "a://\nb/c\nd"]
    df = spark.createDataFrame([(i, u, "r", "s") for i, u in enumerate(some)], "page_id long, url string, RULE string, stack string")
    got = urls.judge(df, urls.rule_table(spark, rules)).collect()
    assert len(got) == len(some) and all(r["stack"] == "s" for r in got)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_judge(some[r.page_id], rules), r.url


def test_urls_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = urls.rule_table(spark, [("net", "/", "block")]).limit(0)
    assert urls.judge(df, none).first().verdict == "allow" and urls.judge(df.limit(0), none).count() == 0


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("the of house tree river in a walks and sees over hill stone cloud".split()) + rng.choice(["", "", ",", "."]) for _ in range(n))
    junk = lambda: " ".join(rng.choice("the of house".split()) + "###" for _ in range(60))
    passage, copy = say(25), say(80)
    docs = [(i, junk() if i % 4 == 0 else say(60), "en", "s", 1) for i in range(300)]
    docs += [(1000, copy, "en", "s", 1), (1001, copy, "en", "s", 1), (1002, say(30) + " " + passage + " " + say(30), "en", "s", 1), (1003, say(60) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + say(5), "en", "s", 1), (None, say(70), None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in at.select("doc_id").collect()}
    first, second, third, fourth, last = kept.values()
    assert not any(i is not None and i < 300 and i % 4 == 0 for i in first) and len(first) > 200
    assert 1000 in second and 1001 not in second and None in second
    assert second - third == {1002} and third == fourth == last
    secret = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 1003").first()
    assert "[secret]" in secret.text and "04db" not in secret.text and secret.n_chars == len(secret.text)
    assert pipeline.run(spark, str(tmp_path)).count() == len(last)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No rows, no labels, no benchmark; null columns; and columns that have the names of results."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, None, None, None, None, 1.0, None), (1, None, "en", "s", 0, 2.0, ["x"]), (1, None, "en", "s", 0, 2.0, ["x"]), (2, "token = abcdefgh", None, "s", 16, 3.0, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, digest array<string>")
    for at, want in ((docs.limit(0), 0), (docs, 3)):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            assert k == len(pipeline.STAGES) - 1 or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{want}-{k}")
            at = spark.read.parquet(f"{tmp_path}/{want}-{k}")
        assert at.count() == want and {"lang", "score", "digest", "n_tokens"} <= set(at.columns)
    assert sorted(map(str, (r.doc_id for r in at.collect()))) == ["1", "2", "None"]


def near_copy_rows(rng):
    """Texts of 40 to 120 made-up words, near copies on both sides of similarity 0.8, a chain of them, and a dense group."""
    word = lambda: "w" + str(rng.randrange(4000))

    def changed(words, n):
        words = list(words)
        for k in rng.sample(range(len(words)), n):
            words[k] = word()
        return words

    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.randrange(40, 120))]
        texts += [base, changed(base, 1), changed(base, 2), base[: len(base) * 9 // 10], base + [word() for _ in range(len(base) // 4)]]
    chain = [word() for _ in range(80)]
    for k in range(8):
        texts.append(chain[k * 4 :] + [word() for _ in range(k * 4)])
    base = [word() for _ in range(60)]
    texts += [changed(base, rng.randrange(3)) for _ in range(60)]
    rows = [" ".join(x) for x in texts] + ["", None, " ", "a b", "A  b", "a b c"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute_near(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def runs(text):
        w = lower(text or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [(i, runs(t)) for i, t in rows]
    for a, x in sets:
        for b, y in sets:
            if a < b and 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i for i in root if find(i) == i}


def test_wide_prints():
    texts = ["", "a", "A b  c", " ".join(f"w{i % 50}" for i in range(300))] + [" ".join(f"w{i * k % 97}" for i in range(5 * k)) for k in range(30)]
    found = near.wide_prints(texts)
    size = 1 << 64
    for k, text in enumerate(texts):
        hashes = []
        for run in near.shingles(text):
            h = near._ODD[0]
            for word in run.split():
                h = (h ^ xxhash.xxh64_intdigest(word)) * near._ODD[1] % size
                h ^= h >> 31
            hashes.append(h)
        for j in range(near.WORDS):
            hashes = [(h ^ h >> 29) * near._ODD[j] % size for h in hashes]
            hashes = [h ^ h >> 32 for h in hashes]
            assert int(found[k, j]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert (near.wide_prints(texts[5:6]) == found[5]).all()
    bits, tables = near.plan(100_000)
    keys = near.table_keys(found.view(np.int64), bits, range(tables))
    assert keys.shape == (len(texts), tables) and (keys >> bits == np.arange(tables)).all() and (near.table_keys(found.view(np.int64), bits, range(2)) == keys[:, :2]).all()


def test_nearest_pairs():
    none = np.empty(0, np.int64)
    assert near._nearest(none, none, none.astype(np.int16)).tolist() == []
    # 1-2 is nearest for both ends, 0-1 for 0 and 2-3 for 3
    assert near._nearest(np.array([0, 1, 0, 2]), np.array([1, 2, 2, 3]), np.array([5, 1, 9, 4], np.int16)).tolist() == [True, True, False, True]


def test_unlike_texts_propose_nothing(spark):
    """Tries whose members are all unlike each other."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(40)]
    assert pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").count() == 40


@pytest.mark.parametrize("settings", [{}, {"LEAF": 16, "CROWDED": 4, "MANY": 1, "LEAST_BITS": 1}])
def test_near_copies_of_the_pipeline(spark, monkeypatch, settings):
    """Small parts make every trie be cut, and dense groups be walked more than once."""
    pipeline = pytest.importorskip("corpus_pipeline")
    for k, v in settings.items():
        monkeypatch.setattr(near, k, v)
    rows = near_copy_rows(random.Random(6))
    want = brute_near(rows)
    docs = spark.createDataFrame(rows + [(None, rows[0][1])], "doc_id long, text string")
    got = [r.doc_id for r in pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert pipeline.near_dedup_stage(spark, docs.limit(0), "").count() == 0


def test_one_id_with_several_texts(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "pq")
    rows = [(1, one, "en"), (1, two, "en"), (1, one + " more", "de"), (1, two, "de"), (2, one, "en"), (3, None, "en"), (3, None, "de")]
    got = pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert {(r.doc_id, r.text) for r in got} in ({(1, t), (1, two), (3, None)} for t in (one, one + " more"))
    assert len(got) == 3 and {r.lang for r in got if r.text in (two, None)} == {"de"}
