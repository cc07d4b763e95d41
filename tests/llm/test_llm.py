"""Operators of the pipeline on small fixtures, against brute force, round trips and held-out labels."""

import gc
import hashlib
import re
import time
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from scorelane.llm import codec, decontam, kit, langid, maxent, ngram_join, packing, pages, quality, rules, shards

WHERE = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key long, label int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def base(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice([f"w{i}" for i in range(500)], n))


@pytest.fixture(scope="module")
def texts():
    one, two = base(120), base(90, 1)
    near = one.split()
    near[60] = "changed"
    return [None, "", " \n\t ", "A b", "a B", one, one, " ".join(near), two, two + " tail", one + " " + two, "line\nline\nline\n", "word " * 60, base(4000, 2), "é ñ 日本 <|endoftext|> don't  x\n\n y", base(30, 3) + " # $ | " * 40]


@pytest.fixture(scope="module")
def docs(spark, texts):
    kit.ship(spark)
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", None, "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", "en", "s", 0, "y", 3, 4)], SCHEMA).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def test_ngram_join(spark, docs, texts):
    def shingles(t):
        w = tokens(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in enumerate(texts)}
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    got = ngram_join.ngram_components(docs).collect()
    assert len(got) == docs.count()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, len(sets[i]), label[i]) for i in sets}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = ngram_join.deduplicated(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({label[i] for i in sets})
    assert ngram_join.ngram_components(empty(spark)).count() == 0


def brute_components(rows):
    """Least id (None without any) reachable over links, by row of rows(id, text)."""
    def shingles(t):
        w = tokens(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, at = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            at = [at[a] if x == at[b] else x for x in at]
    least = {k: min((i for (i, _), x in zip(rows, at) if x == k and i is not None), default=None) for k in set(at)}
    return [(i, len(s), least[x] if s else i) for (i, _), s, x in zip(rows, sets, at)]


def edited(text, places, mark):
    w = text.split()
    for i in places:
        w[i] = f"{mark}{i}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """Chains of near copies through rows without an id, ids with several texts, one large group, a shared passage."""
    rng = np.random.default_rng(5)
    a, shared = base(200, 11), base(40, 12)
    chain = [a, edited(a, (50, 120), "x"), edited(edited(a, (50, 120), "x"), (20, 90), "y"), edited(edited(edited(a, (50, 120), "x"), (20, 90), "y"), (150, 180), "z")]
    rows = [(1, chain[0]), (None, chain[1]), (None, chain[2]), (3, chain[3]), (3, base(60, 13)), (None, base(60, 13)), (2, base(60, 14)), (2, base(60, 14)), (None, base(70, 15)), (None, base(70, 15))]
    rows += [(100 + i, edited(base(120, 16), rng.choice(120, int(rng.integers(0, 3)), False), f"q{i}_")) for i in range(60)]
    rows += [(200 + i, base(30, 300 + i) + " " + shared + " " + base(30, 400 + i)) for i in range(30)]
    return rows + [(300 + i, shared + " " + base(int(rng.integers(4, 14)), 500 + i)) for i in range(30)] + [(None, None), (400, ""), (401, "a b"), (402, "A B")]


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join_of_chains_groups_and_passages(spark, copies, monkeypatch, small):
    if small:  # many blocks and all rounds
        for name, value in (("PIVOT_SHINGLES", 300), ("POSTINGS", 500), ("CELLS", 64), ("PAIRS", 50), ("FEW", 0)):
            monkeypatch.setattr(ngram_join, name, value)
    got = ngram_join.ngram_components(spark.createDataFrame(copies, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_components(copies), key=repr)


def test_product_equals_brute_force():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 60, np.uint64) * np.uint64(2)
    sets = [np.sort(rng.choice(pool, int(rng.integers(20, 60)), False)) for _ in range(40)]
    sets += [np.sort(rng.choice(s, max(1, len(s) - 3), False)) for s in sets[:20]]
    block = (np.arange(len(sets)), np.array([len(s) for s in sets]), np.concatenate(sets))
    want = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert want and set(zip(*ngram_join.product(block, block), strict=True)) == want
    u, v = ngram_join.spanning(*ngram_join.product(block, block))
    assert len(u) <= len(want) and set(zip(u, v, strict=True)) <= want | {(b, a) for a, b in want} | {(a, c) for a, b in want for x, c in want if x == b}


def test_candidates_hold_every_link():
    """All links between components, no more than the pairs allowed, and bounds by bit maps that rule out none."""
    rng = np.random.default_rng(6)
    pool = np.sort(rng.integers(0, 1 << 63, 90, np.uint64) * np.uint64(2))
    sets = [np.sort(rng.choice(pool, int(rng.integers(4, 60)), False)) for _ in range(30)]
    sets += [np.sort(rng.choice(s, max(1, len(s) - int(rng.integers(0, 9))), False)) for s in sets * 3]
    n = np.array([len(s) for s in sets])
    length = n - ngram_join.needed(n) + 1
    rows = [(s[j], i, i // 2, len(s), j) for i, s in enumerate(sets) for j in range(length[i])]
    h, sid, comp, m, place = (np.array(c, np.int64) for c in zip(*((int(a) >> 1, *r) for a, *r in rows), strict=True))
    overlap = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i)}
    links = {(i, j) for (i, j), o in overlap.items() if i // 2 != j // 2 and 100 * o >= 75 * (n[i] + n[j] - o)}
    u, v, left = ngram_join.open_pairs(h, sid, comp, m, place, float("inf"))
    assert links and links <= set(zip(u.tolist(), v.tolist(), strict=True)) and not len(left)
    u, v, left = ngram_join.open_pairs(h, sid, comp, m, place, 0)
    assert set(left) == {x for x in h if len(set(comp[h == x])) > 1} and 0 < len(u) <= 2 * len(h)
    maps = []
    for k, s in enumerate(sets):
        bits = np.zeros(512 << k % 3, bool)
        bits[((s >> np.uint64(20)) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        maps.append(np.packbits(bits).tobytes())
    i, j = (np.array(x) for x in zip(*overlap, strict=True))
    most = ngram_join.most_shared(n[i], n[j], [maps[k] for k in i], [maps[k] for k in j])
    assert (most >= np.array(list(overlap.values()))).all() and (most < np.minimum(n[i], n[j])).any()


def test_similar_sets_are_not_moved_many_times(spark, monkeypatch):
    """Texts that share two thirds of their shingles with others, and no links, over many parts of pivots."""
    monkeypatch.setattr(ngram_join, "PIVOT_SHINGLES", 2000)
    blocks = [base(60, 700 + i) for i in range(40)]
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(blocks[k] for k in rng.permutation(40)[:9])) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    moved = written()
    assert len(ngram_join.ngram_components(docs).collect()) == 240
    assert written() - moved < 8 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("most", [1 << 20, 150, 1])
def test_components_of_any_number_of_tasks(spark, most):
    """The least node of each, in three jobs where one task holds the edges, by rounds where it does not."""
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 500, (300, 2))] + [(1000 + i, 1001 + i) for i in range(100)] + [(-5, 7), (-5, -9), (7, -5)]
    least = {x: x for a, b in edges if a != b for x in (a, b)}
    for _ in least:
        for a, b in (e for e in edges if e[0] != e[1]):
            least[a] = least[b] = min(least[a], least[b])
    made = kit.stored(spark.createDataFrame(edges, "u long, v long").repartition(16), "edges")
    spark.sparkContext.setJobGroup(f"components {most}", "")
    try:
        got = ngram_join.components(made, most)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {most}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["sid"]: r["comp"] for r in got.collect()} == least and got.count() == len(least)
    assert most <= 150 or len(jobs) <= 3


def test_near_duplicates_take_few_jobs(spark):
    """What jobs leave behind, plans above all, adds up in the driver's memory."""
    import corpus_pipeline

    spark.sparkContext.setJobGroup("near duplicates", "")
    try:
        assert corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{WHERE}/documents.parquet"), WHERE).count() == 185
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near duplicates")) < 95
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_tidying_gives_freed_native_memory_back(spark):
    """The driver's JVM keeps what its compiler and buffers have freed, some hundreds of MB in a long session."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) // 1024
    some, rest = jvm.java.util.ArrayDeque(), jvm.java.util.ArrayDeque()
    for i in range(3000):
        (rest if i % 100 else some).add(jvm.java.nio.ByteBuffer.allocateDirect(60_000))
    rest.clear()
    gc.collect()
    for _ in range(2):
        jvm.System.gc()
        time.sleep(1)
    before = held()
    kit.trim(spark)
    assert held() < before - 100


def test_rules_statistics(spark, docs, texts):
    got = {r["doc_id"]: r for r in rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        times = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if times[x] > 1 for j in range(8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert rules.quality_rules(empty(spark)).count() == 0


def test_rules_keep_clean_documents(spark):
    d = kit.table(spark, "/root/testdata/sf0.01", "documents")
    got = rules.quality_rules(d).join(kit.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)] and n.get((0, False), 0) > n.get((0, True), 0)


def test_rules_find_the_least_determinant(spark):
    """Against concentration steps from many random starts."""
    rng = np.random.default_rng(8)
    p = rules.P
    mix = rng.normal(size=(p, p)) * 2
    x = rng.normal(size=(400, p)) @ mix
    x[:80] = 25 + rng.normal(size=(80, p))
    rows = spark.createDataFrame([("s", *map(float, r)) for r in x], "stratum string, " + ", ".join(f"x{i} double" for i in range(p)))
    got = rules.mcd(rows).first()

    def taken(rows):
        return rows.mean(0), np.cov(rows.T, bias=True) * rules.CONSISTENCY + np.diag(np.square(rules.FLOORS))

    best = np.inf
    for _ in range(100):
        mean, cov = taken(x[rng.choice(len(x), p + 1, False)])
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            mean, cov = taken(x[np.argsort(d)[: int(rules.H * len(x))]])
        best = min(best, np.linalg.slogdet(cov)[1])
    assert got["logdet"] <= best + 0.05
    assert np.abs([got[f"m{i}"] for i in range(p)]).max() < 3


def test_shards(spark, docs, texts):
    d = kit.table(spark, WHERE, "documents")
    rows = shards.shards(d, 8).toPandas()
    size = rows.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() <= rows["size"].max()
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    got = {r["doc_id"]: r for r in shards.shards(docs, 3).collect()}
    assert all(got[i]["size"] == len((t or "").encode()) + 16 and got[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    assert shards.shards(empty(spark), 3).count() == 0


def test_decontamination(spark, docs, texts):
    items = {"a": " ".join(base(120).split()[20:40]), "b": "WORD word", "c": "not there at all", "d": "", "e": base(4000, 2)[-200:], "f": None}
    table = spark.createDataFrame([*items.items(), (None, "a b")], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontam.digest(decontam.contamination(docs, table)).collect()}
    for i, t in enumerate(texts):
        w, hit, names = decontam.item_words(t), set(), []
        for name, x in items.items():
            v = decontam.item_words(x)
            k = min(10, len(v))
            want = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            at = [j for j in range(len(w) - k + 1) if k and tuple(w[j : j + k]) in want]
            hit |= {j + o for j in at for o in range(k)}
            names += [name] if at else []
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    near = decontam.contamination(spark.createDataFrame([(1, "one two x three four", 0)], "doc_id long, text string, key int"), spark.createDataFrame([("i", "one two three four")], "item_id string, text string"), slack=1)
    assert near.first()["spans"][0].asDict() == {"first": 0, "end": 5}


def test_decontamination_in_blocks_keeps_rows(spark, monkeypatch):
    rows = [(None, "a b c x"), (None, "x a b c"), (7, "d e f x"), (7, "x x x x"), (7, "x x x x"), (8, "a b c d e f"), (None, None)]
    items = spark.createDataFrame([("i", "a b c"), ("j", "d e f"), ("k", "b c d e"), ("l", "not here")], "item_id string, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    flat = lambda f: sorted(map(repr, f.collect()))
    one = flat(decontam.digest(decontam.contamination(d, items)))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4)
    assert len(one) == len(rows) and flat(decontam.digest(decontam.contamination(d, items))) == one


def test_language_id(spark, docs):
    d = kit.table(spark, WHERE, "documents")
    got = langid.held_out_languages(d).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()
    small = {r["doc_id"]: r for r in langid.held_out_languages(docs).collect()}
    assert all(small[i]["lang_pred"] == "und" for i in (0, 1, 2))
    assert langid.held_out_languages(empty(spark)).count() == 0


def test_code_lengths_are_of_a_distribution():
    trees = langid.Trees({"x": [b"abracadabra" * 4], "y": [b"hocus pocus " * 4]}, order=3)
    p = np.exp2(-trees.bits.astype(float))
    unseen = 256 - (trees.symbol < trees.symbol.max()).sum()
    total = p[:, :-1].sum(1) + p[:, -1] * unseen
    assert np.allclose(total, 1, atol=1e-4)


def test_language_id_learns_every_language(spark):
    words = [base(60, k).replace("w", f"{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(70)]
    rows = [(i, " ".join(np.random.default_rng(i).permutation(words[i % 70].split())), f"l{i % 70:02}") for i in range(70 * 6)] + [(9000, "½ ² Ⅷ ① 12 _", "l00")]
    got = langid.held_out_languages(spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, score string")).collect()
    right = [r["lang_pred"] == f"l{r['doc_id'] % 70:02}" for r in got if r["doc_id"] < 9000]
    assert np.mean(right) > 0.9 and {r["lang_pred"] for r in got if r["doc_id"] == 9000} == {"und"}


def test_quality(spark, docs):
    d, labels = (kit.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = quality.held_out_quality(d, labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    none = quality.held_out_quality(docs, labels.filter("false")).collect()
    assert len(none) == docs.count() and {r["score"] for r in none} == {0.5}


def test_pages(spark):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site.</div><article><h1>Head &amp; line</h1><p><b>First<br> one <i>here</i>.<p>Second one.</article><div id="comments"><p>A reader comment that is long enough to look like text of an article.</p></div><footer>&copy; me</footer></body></html>'
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (3, "v", "")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in pages.extracted(rows).collect())
    want = "Head & line\n\nFirst one here.\n\nSecond one."
    assert got == [(1, want, len(want)), (2, "", 0), (3, "", 0), (3, "", 0)]


def test_pages_keep_articles_in_named_wrappers():
    text = "A sentence of the article that is long enough to be its text and has no link in it."
    for page in (f'<div class="has-sidebar"><article><p>{text}</article></div>', f"<form><div><p>{text}</p></div></form>", f'<form id="f"><nav><a href=x>Home</a></nav><main><p>{text}</main></form>', f"<html><head><title>t</title><body><article><p>{text}</article>", f"<article><button>ok<p>{text}</article>"):
        assert text in pages.main_text(page) and "Home" not in pages.main_text(page)
    assert pages.main_text(f'<article><p>{text}</article><div id="comments"><article class="comment"><p>{text}</article></div>') == text


def test_pages_by_neighbours():
    text = "A sentence of the article that is long enough to be its text and has no link in it, with many more words, so that it is a paragraph of good length and not only a line of some list."
    nav, link = "<nav><a href=x>Home</a> <a href=y>News</a></nav>", "<div><a href=z>Two</a></div>"
    plain = f"{nav}<div><h1>Big title</h1><p>{text}</p><p>{text}</p></div>{link}"
    assert pages.main_text(plain) == f"Big title\n\n{text}\n\n{text}"
    blurb = "<ul><li><a href=a>One</a><li><p>Some words of a blurb that nobody reads at all.<li><a href=b>Two</a></ul>"
    assert pages.main_text(f"{blurb}<div><p>{text}</div>") == text
    assert pages.main_text(f'<div class="post-12 type-post hentry tag-y"><p>{text}</p><p>{text}</p></div>') == f"{text}\n\n{text}"
    assert pages.main_text(f'<article><p>{text}</p><section id="search"><h2>Trees</h2><p>{text}</p></section></article>') == f"{text}\n\nTrees\n\n{text}"
    assert pages.main_text(f'{nav}<article><header class="article-header"><h1>Title</h1></header><p>wo<!-- c -->rd <math><mi>x</mi></math> {text}</p><p>End.</p></article>{link}') == f"Title\n\nword x {text}\n\nEnd."

    def used(t):
        return set() if t.feature < 0 else {t.feature} | used(t.low) | used(t.high)

    assert used(pages.TREE) & {2, 3, 4, 5}


def test_empty_tables_of_every_operator(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id string, text string")
    assert quality.held_out_quality(empty(spark), labels).count() == 0
    assert pages.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert decontam.contamination(empty(spark), items).count() == 0
    assert codec.read_back(codec.written(empty(spark))).count() == 0


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def test_encoder_equals_the_library(texts):
    strange = [*texts, "a'sb 'll ''t  x\t\ty \n z  ", "\x1c a\x1fb \x85c\xa0d", "½ ²x Ⅷ _a_ 1a", "don't stop"]
    ids, edges = packing.Encoder(packing.vocabulary_path())(strange)
    for i, t in enumerate(strange):
        assert ids[edges[i] : edges[i + 1]].tolist() == library().encode(t or "", add_special_tokens=False).ids


def test_packing(spark, docs, texts):
    rows = packing.packed(docs, length=64).toPandas()
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 64
    for i, t in enumerate(texts):
        ids = [*library().encode(t or "", add_special_tokens=False).ids, 0]
        g = rows[rows["doc_id"] == i].drop_duplicates("piece").sort_values("piece")
        assert g["length"].sum() == len(ids) and (g["length"].iloc[1:] == 64).all()
        for start, n, crc in g[["start", "length", "ids_crc32"]].astype(int).values.tolist():
            assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
    assert packing.packed(empty(spark)).count() == 0


def test_packing_does_not_grow_with_partitions(spark):
    d = spark.createDataFrame([(i, base(5 + i * 37 % 90, i)) for i in range(300)], "doc_id long, text string")
    n = [packing.packed(d.repartition(k)).select("sequence_id").distinct().count() for k in (1, 40)]
    assert n[1] <= n[0] + 1


def test_packer_takes_the_best_fit():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 7, 3, 4, 9, 9, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (3, 9)]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 50257, n), rng.integers(0, 9, n)).astype(np.uint32)
    coded = codec.encode(ids, 1000)
    assert (codec.decode(coded) == ids).all()
    if n > 1:
        k, crc, data = coded[1]
        with pytest.raises(ValueError):
            codec.decode([coded[0], (k, crc, data[:50] + bytes([data[50] ^ 1]) + data[51:])])


def test_pieces_of_written_out_classes():
    """Every character below U+10000 beside letters, digits and spaces; wider strings are known by their size."""
    for c in map(chr, range(1, 1 << 16)):
        text = f"a{c}b {c}{c} 1{c}9 {c} "
        assert packing.plane_pieces().findall(text) == packing.Encoder.PIECES.findall(text)
    for c in "\U00010000", "\U0001f642", "\U0010ffff":
        assert all((x + c).__sizeof__() >= 4 * (len(x) + 1) for x in ("", "a", "é" * 100, "日" * 5000))


@pytest.mark.parametrize("block", [1, 3, 100, 1024])
def test_codec_of_uneven_blocks(block):
    """Carries, ids that fill the whole range, blocks alone and in another order, tables that are damaged or absent."""
    rng = np.random.default_rng(block)
    for ids in (np.where(rng.random(1500) < 0.99, 5, rng.integers(0, 65536, 1500)), np.full(1500, 65535), np.arange(1500) * 43, np.zeros(7, int)):
        coded = codec.encode(ids.astype(np.uint32), block)
        assert (codec.decode(coded) == ids).all()
        alone = [codec.decode([coded[0], x]) for x in coded[1:]]
        assert (np.concatenate(alone) == ids).all() and max(map(len, alone)) <= block and not coded[0][0]
        assert (codec.decode([*coded[:0:-1], coded[0]]) == np.concatenate(alone[::-1])).all()
        with pytest.raises(ValueError):
            codec.decode([(0, coded[0][1] ^ 1, coded[0][2]), *coded[1:]])
        with pytest.raises(ValueError):
            codec.decode(coded[1:])


def test_codec_takes_under_a_microsecond_an_id():
    ids = np.random.default_rng(3).zipf(1.3, 500_000).clip(0, 50256).astype(np.uint32)
    began = time.process_time()
    coded = codec.encode(ids)
    assert (codec.decode(coded) == ids).all()
    assert time.process_time() - began < 1e-6 * len(ids)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * sum(len(x[2]) for x in coded) < 1.05 * -(share * np.log2(share)).sum() * len(ids)


def test_id_files(spark, docs, texts, tmp_path):
    every = codec.read_back(codec.written(docs, out=f"{tmp_path}/ids")).collect()  # nulls first, repeated rows each
    assert len(every) == docs.count() and sorted(every, key=lambda r: r["start"])[0]["doc_id"] is None
    got = codec.read_back(codec.written(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]))).orderBy("doc_id").collect()
    at = 0
    for i, (r, t) in enumerate(zip(got, texts, strict=True)):
        ids = [*library().encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_maxent(spark, docs, texts):
    got = [r for r in maxent.scored(docs).collect()]
    assert len(got) == docs.count()
    train = [r["text"] for r in docs.collect() if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    c = Counter(x for t in train for x in [*tokens(t), "\n"])
    n, v = sum(c.values()), len(c)
    for r in got:
        w = [*tokens(texts[r["doc_id"]] if r["doc_id"] is not None else "no id here"), "\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] < 0
    assert maxent.scored(empty(spark)).count() == 0
    logs = maxent.log_classes(np.random.default_rng(0).normal(size=(maxent.BUCKETS, maxent.CLASSES)), np.arange(50))
    assert np.allclose(np.exp(logs).sum(1), 1)


def test_maxent_learns_the_order_of_words_of_one_class(spark):
    cycle = [f"a{i}z" for i in range(20)]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    texts = {i: " ".join(cycle * 10) for i in range(200)} | {held[1]: " ".join(cycle[::-1] * 10)}
    got = {r["doc_id"]: r for r in maxent.scored(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    right, wrong = (got[i] for i in held)
    assert right["base_score"] == pytest.approx(wrong["base_score"]) and right["score"] > wrong["score"] + 50
    train = spark.createDataFrame([(t,) for t in texts.values()], "text string")
    history = maxent.trained(train, 1, maxent.BUCKETS)[1]
    assert 1 < len(history) < maxent.PASSES and history[-1] > history[0]
    assert maxent.shape(10**8)[0] > 1 and maxent.shape(10**9)[1] > maxent.shape(10**8)[1] > maxent.BUCKETS


@pytest.mark.parametrize("head", [15, 3])
def test_maxent_scores_equal_brute_force(spark, docs, monkeypatch, head):
    """Word by word from the weights and plain counts; and the outcomes of a context add up to 1."""
    monkeypatch.setattr(maxent, "HEAD", head)  # at 3 most words are beyond the head
    monkeypatch.setattr(maxent, "HELD", 50)
    monkeypatch.setattr(maxent, "PASSES", 1)
    own = maxent.keyed(docs, "doc_id", "text")
    counts, weights, blocks = maxent.fitted(own)
    rows = own.collect()

    def hashed(w):
        b = w.encode()
        return (kit.hash_of(w) & ~31) | int(maxent._classes()[b[0] << 8 | b[-1]])

    c = Counter(hashed(w) for r in rows if not r["held_out"] for w in tokens(r["text"]))
    cell = lambda h: int(maxent.cells(np.array([h], np.uint64), counts.depth)[0])
    size = Counter()
    for h, n in c.items():
        size[cell(h)] += n + 1

    def path(h, one, two):
        at, outcome, _ = maxent.choices(np.array([h], np.uint64), [np.array([x], np.uint64) for x in (one, two)], counts.depth, len(weights) - maxent.nodes(counts.depth))
        z = weights[at].astype(float).sum(1)
        return float((z[np.arange(len(z)), outcome] - np.log(np.exp(z).sum(1))).sum() / np.log(10))

    def score(text):
        total, one, two = 0.0, maxent.END, maxent.END
        for w in tokens(text):
            h = hashed(w)
            total += path(h, one, two) + np.log10((c[h] + 1) / (size[cell(h)] + 1))
            one, two = h, one
        return total + path(maxent.END, one, two)

    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in maxent.scored(docs).collect()}
    small = [r for r in rows if len(r["text"]) < 2000]
    assert len(small) > 8
    for r in small:
        assert got[r["doc_id"], len(tokens(r["text"])) + 1] == pytest.approx(score(r["text"]), rel=1e-4)
    assert (len(counts.head) > 0.9 * len(c)) == (head == 15)
    some = np.random.default_rng(1).integers(0, 1 << 64, 40_000, np.uint64)
    ways = {cell(h): int(h) for h in some if int(h) & 31 != maxent.END}
    assert len(ways) == 31 * 32 and counts.depth == 1
    context = np.full(len(ways) + 1, hashed("w1"), np.uint64), np.full(len(ways) + 1, hashed("w2"), np.uint64)
    at, outcome, token = maxent.choices(np.array([*ways.values(), maxent.END], np.uint64), list(context), 1, len(weights) - maxent.nodes(1))
    p = np.exp(np.bincount(token, maxent.log_classes(weights.astype(float), at)[np.arange(len(at)), outcome]))
    assert p.sum() == pytest.approx(1, abs=1e-6)


def test_maxent_run_sums():
    n = np.array([1, 7, 2, 1, 64, 3, maxent.LONG, maxent.LONG + 1, 500, 1])
    rng = np.random.default_rng(0)
    x, at = rng.normal(size=(50, 4)), rng.integers(0, 50, n.sum())
    order, sums = maxent.run_sums(x, at, n)
    assert sorted(order) == list(range(len(n)))
    assert np.allclose(sums, np.add.reduceat(x[at], np.cumsum(n) - n, axis=0)[order])
    order, sums = maxent.run_sums(x, at[:0], n[:0])
    assert len(order) == 0 and sums.shape == (0, 4)


def test_maxent_step_is_adagrad_and_large_scores_stay_finite():
    rng = np.random.default_rng(2)
    for scale in (1.0, 100.0):
        w = (scale * rng.normal(size=(40, maxent.CLASSES))).astype(np.float32)
        rows = np.stack([32 + rng.integers(0, 8, 300), rng.integers(0, 32, 300), rng.integers(0, 32, 300)], 1)
        outcome = rng.integers(0, maxent.CLASSES, 300)
        z = w[rows].astype(float).sum(1)
        logs = z - np.logaddexp.reduce(z, 1, keepdims=True)
        assert np.allclose(maxent.log_outcomes(w, rows, outcome), logs[np.arange(300), outcome], rtol=1e-4, atol=1e-3)
        d = -np.exp(logs)
        d[np.arange(300), outcome] += 1
        g = np.zeros(w.shape)
        for k in range(3):
            np.add.at(g, rows[:, k], d)
        squares = (g**2).sum(1)
        want = w + maxent.RATE * g / (np.sqrt(squares) + 1e-6)[:, None]
        got, q, used = w.copy(), np.zeros(40, np.float32), np.zeros(40, np.float32)
        met = maxent.step(got, q, used, rows, outcome, 32)
        assert met == pytest.approx(logs[np.arange(300), outcome].sum(), rel=1e-4)
        assert np.allclose(got, want, rtol=1e-3, atol=1e-3) and np.allclose(q, squares, rtol=1e-2, atol=1e-3)
        assert used.sum() == 900


def test_stages_filter_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    where = str(tmp_path)
    spark.createDataFrame([("i", "one two three four")], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    clean, dirty, short = base(60), base(60, 1) + " one two three four", "too short"
    rows = [(None, clean), (None, dirty), (None, short), (7, base(60, 2)), (7, dirty + " x"), (7, short)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda f: sorted(((r["doc_id"], r["text"]) for r in f.collect()), key=repr)
    assert left(corpus_pipeline.quality_rules(spark, d, where)) == sorted((x for x in rows if x[1] != short), key=repr)
    assert left(corpus_pipeline.decontaminate(spark, d, where)) == sorted((x for x in rows if "one two" not in x[1]), key=repr)
    copies = [(None, clean), (None, clean), (3, clean), (None, base(60, 3)), (None, base(60, 3)), (7, base(60, 4)), (7, base(60, 5)), (9, base(60, 4))]
    d = spark.createDataFrame(copies, "doc_id long, text string").coalesce(1)
    assert left(corpus_pipeline.near_duplicates(spark, d, where)) == sorted([(3, clean), (None, base(60, 3)), (7, base(60, 4)), (7, base(60, 5))], key=repr)


def test_stages_take_any_table(spark, tmp_path):
    """Empty tables, nulls everywhere, repeated rows, and columns named like those the stages make."""
    import corpus_pipeline

    where = str(tmp_path)
    spark.createDataFrame([("i", "one two three four"), (None, None)], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    clash = ["_id", "_row", "row", "ROW_", "score", "predicted", "_text", "n_words", "kept", "stratum", "x0", "sid", "h", "comp", "items", "quality", "key", "open", "length"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    long = base(150, 21)
    rows = [(None, None), (None, None), (1, ""), (1, base(60)), (1, base(60)), (2, base(60)), (3, long), (None, base(70, 22)), (3, base(50, 23) + " one two three four")]
    for table in ([], [(i, t, None, None, None, *clash) for i, t in rows]):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, where)
            assert after.columns == docs.columns
            docs = kit.stored(after, "after")
            assert {tuple(r[c] for c in clash) for r in docs.collect()} <= {tuple(clash)}
        got = sorted({(r["doc_id"], r["text"]) for r in docs.collect()}, key=repr)
        assert got == (sorted([(1, base(60)), (3, long), (None, base(70, 22))], key=repr) if table else [])
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, where)
        assert packed.select("doc_id").distinct().count() == len(got)


def test_stages_copy_no_files(spark, tmp_path, monkeypatch):
    """Rows of files are numbered where they lie, alike each time; the run keeps no stage's table but the last."""
    import corpus_pipeline

    rows = [(i % 7, f"t{i}") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, _path string").repartition(4).write.parquet(f"{tmp_path}/t")
    made = len(kit._written)
    own = kit.numbered(spark.read.parquet(f"{tmp_path}/t"), "row")
    assert len(kit._written) == made and own.columns == ["doc_id", "_path", "row"]
    got = own.collect()
    assert sorted(tuple(r[:2]) for r in got) == sorted(rows) and len({r["row"] for r in got}) == 50
    assert {(r["row"], r["_path"]) for r in own.repartition(3).collect()} == {(r["row"], r["_path"]) for r in got}
    names = []
    was = kit.stored
    monkeypatch.setattr(kit, "stored", lambda df, name: names.append((name, x := was(df, name))) or x)
    corpus_pipeline.run(spark, WHERE)
    left = {n for n, x in names if (spark, x._stored_at) in kit._written}
    assert not left & {"numbered", *(n for n, _ in corpus_pipeline.STAGES[:3])}


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = kit.table(spark, WHERE, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = kit.stored(stage(spark, docs, WHERE), name)
        assert after.columns == columns and 0 < after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, WHERE)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert names == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "packing"]
