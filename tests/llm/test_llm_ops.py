"""The text operators against brute force, on small tables with nulls, empty texts, repeats, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontam, htmltext, lines, packing, quality, rules, secrets, simhash, substr, urls
from tidemark.llm.components import connected_components
from tidemark.llm.fmindex import FMIndex, WaveletTree, bounded_suffix_array, matching_statistics
from tidemark.llm.wordhash import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, score double, component_id long, drop string, key long, words string, h long, task long"


def frame(spark, rows):
    """Documents with columns that clash with names the operators use."""
    return spark.createDataFrame([(i, t, f"src{n % 4}", 0.5, -1, "d", 3, "w", 4, 5) for n, (i, t) in enumerate(rows)], SCHEMA)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", "\n"]) for _ in range(k))
    passage = text(45)
    rows = [(i, text(r.randint(1, 160))) for i in range(n)]
    rows += [(n + i, text(20) + " " + passage + " " + text(30)) for i in range(12)]
    rows += [(n + 20 + i, rows[3 + i][1]) for i in range(5)]
    for i in range(6):
        words = rows[10][1].split(" ") + text(120).split(" ") if i == 0 else words
        edited = list(words)
        edited[r.randrange(len(edited))] = "edited"
        rows.append((n + 40 + i, " ".join(edited)))
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "a " * 300), (905, "ab cd " * 200), (None, "no id " * 30), (906, passage)]
    return rows + [rows[5], (907, "é " * 40 + passage.replace(" ", "  \n"))]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# 1


def shingles(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(k, len(words))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def contains(text, need, item):
    """Of an item's shingles, those in the text: of five words, or of all of a shorter item's."""
    k = min(5, len(WORD.findall(item)))
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return need & {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_contained_items_are_those_of_brute_force(spark, docs, rows, empty):
    text = rows[62][1].split()
    items = [(1, " ".join(text[25:60])), (2, "Not in there at all, of course, is this one"), (3, None), (4, ""), (5, "one"), (6, " ".join(text[22:30]).upper()), (7, " ".join(text[20:45] + ["x"])), (7, rows[0][1]), (8, " ".join(text[30:33])), (9, text[40].upper()), (10, "not here"), (11, "é É")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect())
    want = Counter()
    for i, t in rows:
        for j, u in items:
            need = shingles(u)
            if need and len(contains(t, need, u)) >= 0.8 * len(need):
                want[i, j] += 1
    assert got == want and (62, 1) in got and (62, 8) in got and (62, 9) in got
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in rows if not any(k[0] == i for k in want))
    assert decontam.contaminated(empty, bench).collect() == []
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []


def test_benchmark_ids_may_be_text(spark, docs, rows):
    text = rows[62][1].split()
    bench = spark.createDataFrame([("suite/1", " ".join(text[25:60])), ("suite/2", "two words")], "item_id string, text string")
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(named, bench).collect()}
    assert ("d62", "suite/1") in got and all(i.startswith("d") and j == "suite/1" for i, j in got)
    assert "d62" not in {r["doc_id"] for r in decontam.decontaminate(named, bench).collect()}


def test_benchmark_in_blocks(spark, docs, rows, monkeypatch):
    bench = spark.createDataFrame([(i, t) for i, t in rows if i is not None and i < 40], "item_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(docs.where("doc_id < 100"), bench).collect()))
    monkeypatch.setattr(decontam, "BYTES_PER_PASS", 9000)
    assert sorted(map(tuple, decontam.contaminated(docs.where("doc_id < 100"), bench).collect())) == whole
    monkeypatch.setattr(decontam, "ITEMS_PER_PASS", 15)
    assert sorted(map(tuple, decontam.contaminated(docs.where("doc_id < 100"), bench).collect())) == whole


# 2


def test_pages(spark):
    cases = {
        "": "",
        "<html><body><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><article><h1>The title</h1><p>First&nbsp;line, &amp; more.<br>Next<p>Second <b>bold</b> word, and so on.</p></article><footer>&copy; someone.</footer></body></html>": "The title First line, & more. Next Second bold word, and so on.",
        "<div id=header>Site</div><div class=content><p>One long sentence, that says something of interest.</p><div class=ad>Buy this now, it is cheap.</div><p>Another long sentence, that goes on.</p></div><div class=comments><p>I liked it, really.</p></div>": "One long sentence, that says something of interest. Another long sentence, that goes on.",
    }
    pages = spark.createDataFrame([(i, "u", h, "old") for i, h in enumerate(cases)] + [(9, None, None, "x")], "page_id long, url string, html string, main_text string")
    got = {r["page_id"]: r["main_text"] for r in htmltext.extract_pages(pages).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[9] == ""
    assert htmltext.extract_pages(pages.limit(0)).collect() == []


PARAGRAPHS = [f"The {w} paragraph says something of interest, and it goes on for a while." for w in ("first", "second", "third", "fourth")]


@pytest.mark.parametrize(
    "middle",
    [
        "<button>Share",
        "<button class=x><div>Share</div></button>",
        "<button>Share</button><svg><path d='M0 0'/>",
        "<svg><g><svg><text>inner</text></svg><text>label</text></g></svg>",
        "<video src=a><source src=b>",
        "<video><p>No video here, sadly.</p></video>",
        "<select><option>One<option>Two</select>",
        "<noscript><p>Please turn on scripts, dear reader.</p></noscript>",
        "<!-- a comment > with more -->",
        "<script>var a = '<p>not text, of course.</p>';</script>",
        "<iframe src=x><p>not text, really.</p></iframe>",
        '<img alt="a > b">',
    ],
)
def test_what_is_skipped_ends_where_it_should(middle):
    source = "<html><body><nav><a href=/>Home</a></nav><article>" + middle.join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</article><footer>Nobody reads this.</footer></body></html>"
    assert htmltext.extract([source], htmltext.trained()) == [" ".join(PARAGRAPHS)]


@pytest.mark.parametrize("start", ["<p title=it's>", "<p title='a'b>", '<p title="a>', "<p title='>", "<p ' \">", '<p title=a"b>', "<p title = \"x > y\" class='z'>", "<p data-a=\"1\"data-b='2'>"])
def test_quotes_that_are_not_paired_lose_no_text(start):
    source = "<html><body><article><h1>One title of it</h1>" + "".join(f"{start}{p}</p>" for p in PARAGRAPHS) + "</article></body></html>"
    assert htmltext.extract([source], htmltext.trained()) == [" ".join(["One title of it", *PARAGRAPHS])]


def test_long_broken_pages_take_linear_time():
    import time

    for bit in ("<!--", "<button>", "<video>", "<svg>", "<p title='", '<a href="', "<script", "<b", "<textarea>", "<title>", "<noscript><div>"):
        began = time.time()
        htmltext.Page("<p>Some text.</p>" + (bit + " x ") * 40_000)
        assert time.time() - began < 8, bit


def test_pages_that_were_not_trained_on():
    writer, model = htmltext._Writer(77), htmltext.trained()
    right = kept = wanted = 0
    for _ in range(60):
        source = writer.page()
        page = htmltext._Labelled(source)
        label = list(page.label)
        for i in range(1, len(label)):
            label[i] = label[i] if label[i] >= 0 else label[page.parent[i]]
        want = Counter(w for n, t, _ in page.texts if label[n] == 1 for w in t.split())
        got = Counter(htmltext.extract([source], model)[0].split())
        right, kept, wanted = right + sum((want & got).values()), kept + sum(got.values()), wanted + sum(want.values())
    assert right / kept > 0.97 and right / wanted > 0.97


def test_broken_markup_never_fails():
    r = random.Random(3)
    bits = ["<p>", "</p>", "<div class='ad", "'>", "<!--", "-->", "<script>", "</script>", "&am", "&#x41;", "text, more.", "<td>", "</article>", "<article>", "<", ">", '"', "<br/>", "<x-y>"]
    model = htmltext.trained()
    for _ in range(200):
        assert isinstance(htmltext.extract(["".join(r.choice(bits) for _ in range(r.randint(0, 30)))], model)[0], str)


# 3


def test_quality_learns_from_the_right_fold(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(200)]
    good = lambda: " ".join(r.choice(words) for _ in range(80)).capitalize() + "."
    bad = [lambda: " ".join(r.choice(words) + "###" for _ in range(80)), lambda: " ".join([r.choice(words)] * 80), lambda: good().upper().replace(" ", "!! ")]
    rows = [(i, good() if i % 3 else r.choice(bad)(), int(i % 3 > 0)) for i in range(600)]
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(700, None), (701, ""), (None, "x"), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    got = [(x["doc_id"], x["score"]) for x in scored.collect()]
    assert len(got) == len(rows) + 4 and all(0 <= s <= 1 for _, s in got)
    held = {i: s for i, s in got if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(s >= 0.3) == (i % 3 > 0) for i, s in held.items()]) > 0.97
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.train(docs, flipped).weights, model.weights)
    one = quality.train(docs, labels.where("quality = 1"))
    assert np.allclose([x["score"] for x in quality.score(docs, one).select("score").collect()], 1 / (1 + np.exp(-one.shift)))
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).collect() == []


def test_ids_may_be_text(spark, docs, rows):
    """The same results, whatever the ids' type is."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    some = docs.where("doc_id IS NOT NULL")
    name = F.format_string("d%06d", "doc_id")
    named, key = some.withColumn("doc_id", name), lambda i: f"d{i:06d}"
    pieces = lambda x: Counter((p["doc_id"], p["start"]) for p in packing.pack(x, path, size=64).collect() if not p["start"])
    assert pieces(named) == Counter({(key(i), s): n for (i, s), n in pieces(some).items()})
    groups_ = lambda x: Counter((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(x).collect())
    assert groups_(named) == Counter({(key(i), f, key(c)): n for (i, f, c), n in groups_(some).items()})
    assert Counter(r["doc_id"] for r in simhash.keep_first(named).collect()) == Counter(key(r["doc_id"]) for r in simhash.keep_first(some).collect())
    kept = lambda x: Counter((r["doc_id"], r["text"]) for r in lines.drop_recurring_lines(x, min_docs=3, long_docs=3).collect())
    assert kept(named) == Counter({(key(i), t): n for (i, t), n in kept(some).items()})
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows if i is not None], "doc_id long, quality int")
    model = quality.train(named, labels.withColumn("doc_id", name))
    assert {r["doc_id"] for r in quality.score(named, model).collect()} == {key(i) for i, _ in rows if i is not None}
    assert {r["doc_id"] for r in secrets.scan(named).collect()} == {key(i) for i, _ in rows if i is not None}


def test_ids_that_repeat_with_other_texts_lose_nothing(spark):
    r = random.Random(31)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    footer = text(6)
    rows = [(i % 7, "\n".join([text(20), text(15), footer])) for i in range(40)]
    docs = frame(spark, rows).repartition(3)
    got = Counter((x["doc_id"], x["text"]) for x in lines.drop_recurring_lines(docs).collect())
    cut = Counter((i, t.removesuffix("\n" + footer)) for i, t in rows)
    assert sum((got - cut).values()) == 1 and all(t.endswith(footer) for _, t in got - cut)
    assert Counter((x["doc_id"], x["text"]) for x in simhash.keep_first(docs).collect()) == Counter(rows)
    twice = frame(spark, rows + rows[:10])
    assert Counter((x["doc_id"], x["text"]) for x in simhash.keep_first(twice).collect()) == Counter(rows)


def test_very_long_texts(spark):
    """One long document among short ones, through every operator: whole, and in time that follows its length."""
    r = random.Random(33)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    long = "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(25_000))
    item = " ".join(r.choice(words) for _ in range(30))
    secret = "key " + " ".join(f"{i:024x}" for i in range(3000))
    rows = [(1, long), (2, long[1_000_000:1_000_600]), (3, "short one"), (4, long + " " + item), (5, secret), (6, "x" * 300_000)]
    docs = frame(spark, rows).repartition(2)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [x["doc_id"] for x in decontam.contaminated(docs, bench).collect()] == [4]
    gone = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substr.remove_repeats(docs).collect()}
    assert gone[1] == (300_000, 0) and gone[4] == (300_030, 300_000) and gone[2][1] > 20
    groups_ = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs).collect()}
    assert groups_[4] == 1 and groups_[3] == 3 and {x["doc_id"] for x in simhash.keep_first(docs).collect()} == {1, 2, 3, 5, 6}
    assert {x["doc_id"]: x["n_lines"] for x in lines.line_report(docs).collect()}[1] == 25_000
    spans = {x["doc_id"]: x["n"] for x in secrets.scan(docs).select("doc_id", F.size("spans").alias("n")).collect()}
    assert spans == {1: 0, 2: 0, 3: 0, 4: 0, 5: 3000, 6: 0}
    assert {x["doc_id"]: x["n_words"] for x in rules.score(docs).collect()}[1] == 300_000
    path = public_tokenizers.path("byte_bpe_50k.json")
    total = Counter()
    for p in packing.pack(docs, path, size=1024).select("doc_id", "length", "doc_tokens").collect():
        total[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert all(n == tokens for (_, tokens), n in total.items()) and len(total) == 6
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (6, 0)], "doc_id long, quality int")
    assert quality.score(docs, quality.train(docs, labels)).count() == 6
    hosts = [".".join(["a"] * 2000) + ".com", "b.net", "x" * 100_000]
    pages = spark.createDataFrame([(i, f"http://{h}/{'p' * 50_000}") for i, h in enumerate(hosts)], "page_id long, url string")
    known = spark.createDataFrame([("com", "/", "block"), ("a.a.com", "/p", "allow")], "host string, path string, verdict string")
    assert [x["verdict"] for x in urls.judge(pages, known).orderBy("page_id").collect()] == ["allow", "allow", "allow"]


# 4


def plain_fingerprint(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(k, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash_groups_are_those_of_brute_force(spark, docs, rows, empty, hot):
    got = simhash.near_duplicates(docs, hot_key=hot, block=4 if hot == 1 else 1024).collect()
    prints = {(i, t): plain_fingerprint(t, 4) for i, t in rows}
    first = {}
    for (i, _), f in prints.items():
        if i is not None:
            first[f] = min(i, first.get(f, i))
    comp = groups(list(first), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {c: min(first[f] for f in first if comp[f] == c) for c in set(comp.values())}
    want = Counter((i, f, None if i is None else least[comp[f]]) for i, t in rows for f in [prints[i, t]])
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("hot,block,segments", [(64, 1024, None), (2, 16, 3), (2, 16, 2), (64, 1024, 2), (64, 1024, 5), (3, 16, 4)])
def test_links_connect_dense_clusters(spark, hot, block, segments):
    r = random.Random(9)
    center = r.getrandbits(64)
    values = {center}
    while len(values) < 150:
        x = r.choice(sorted(values))
        for _ in range(r.randint(1, 3)):
            x ^= 1 << r.randrange(64)
        values.add(x)
    values |= {r.getrandbits(64) for _ in range(50)}
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    nodes = spark.createDataFrame([(s, s) for s in signed.values()], "node long, fp long").cache()
    links = simhash.near_links(nodes, 4, segments, hot_key=hot, block=block)
    got = {x["node"]: x["component"] for x in connected_components(links, "a", "b").collect()}
    want = groups(sorted(signed.values()), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 4)
    assert {n: got.get(n, n) for n in want} == want


def test_near_copies_leave_one(spark, docs, rows, empty):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert max(ids.values()) == 1 and ids[None] == 1
    assert not {80, 81, 82, 83, 84} & set(ids)  # exact copies
    assert len({100, 101, 102, 103, 104, 105} & set(ids)) == 1  # near copies
    assert len({900, 901, 902} & set(ids)) == 1
    shared = lambda a, b: len(a & b) >= 0.5 * len(a | b)
    texts = {i: shingles(t) for i, t in rows if i is not None}
    alone = [i for i in texts if not any(i != j and shared(texts[i], texts[j]) for j in texts) and texts[i]]
    assert set(alone) <= set(ids)
    assert simhash.keep_first(empty).collect() == []


def test_copies_with_an_added_or_cut_passage_are_found(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows, pairs = [], defaultdict(list)
    for n in range(360):
        words = [r.choice(vocabulary) for _ in range(r.choice([60, 300, 900]))]
        share = r.uniform(0.12, 0.2)
        more, less = int(len(words) * share), int(len(words) * (1 - share))
        edited = [r.choice(vocabulary) if r.random() < 0.02 else w for w in words]
        kinds = {"tail": words + [r.choice(vocabulary) for _ in range(more)], "head": [r.choice(vocabulary) for _ in range(more)] + words, "cut": words[:less], "edited": edited}
        kind = list(kinds)[n % 4]
        a, b = " ".join(words), " ".join(kinds[kind])
        rows += [(2 * n, a), (2 * n + 1, b)]
        if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)):
            pairs[kind].append(n)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, rows).repartition(3)).collect()}
    for kind, of in pairs.items():
        found = sum(got[2 * n] == got[2 * n + 1] for n in of)
        print(kind, found, len(of))
        assert len(of) > 40 and found >= 0.97 * len(of), (kind, found, len(of))
    assert all(got[i] in (i, i - i % 2) for i, _ in rows)  # unrelated texts stay apart


@pytest.mark.parametrize("hot,block", [(64, 1024), (2, 16)])
def test_bands_connect_what_their_pairs_connect(spark, hot, block):
    r = random.Random(13)
    rows = [(i, r.getrandbits(6), [r.randrange(12), 100 + r.randrange(12)]) for i in range(120)]
    nodes = spark.createDataFrame(rows, "node long, w long, bands array<long>").repartition(3)
    want = groups([i for i, _, _ in rows], lambda a, b: bool(set(rows[a][2]) & set(rows[b][2])) and (rows[a][1] ^ rows[b][1]).bit_count() <= 1)
    got = {x["node"]: x["component"] for x in connected_components(simhash.band_links(nodes, "bands", ["w"], 1, hot, block), "a", "b").collect()}
    assert {n: got.get(n, n) for n in want} == want


@pytest.mark.parametrize("hot,block", [(64, 1024), (2, 16)])
def test_one_search_connects_what_each_search_connects(spark, hot, block):
    r = random.Random(14)
    centers = [r.getrandbits(64) for _ in range(6)]

    def near_a_center():
        x = r.choice(centers)
        for _ in range(r.randint(0, 3)):
            x ^= 1 << r.randrange(64)
        return x - (1 << 64) if x >> 63 else x

    rows = [(i, near_a_center() if i % 3 else r.getrandbits(63), near_a_center() if i % 2 else r.getrandbits(63), r.getrandbits(6), [r.choice([1, -1]) * r.randrange(1, 60)]) for i in range(120)]
    nodes = spark.createDataFrame(rows, "node long, p long, q long, w long, bands array<long>").repartition(3)
    bits = lambda a, b: ((a ^ b) % (1 << 64)).bit_count()
    # keys of bands lack their highest bit
    band = lambda x: x % (1 << 63)
    linked = lambda a, b: bits(rows[a][3], rows[b][3]) <= 1 and (min(bits(rows[a][1], rows[b][1]), bits(rows[a][2], rows[b][2])) <= 4 or band(rows[a][4][0]) == band(rows[b][4][0]))
    want = groups([x[0] for x in rows], linked)
    links = simhash._search(nodes, ["p", "q"], "bands", 4, 3, ["w"], 1, hot, block)
    got = {x["node"]: x["component"] for x in connected_components(links, "a", "b").collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_near_copies_search_hot_keys_once(spark, monkeypatch):
    """Fingerprints and bands share one table of keys; three searches took check_h beyond its disk."""
    r = random.Random(15)
    words = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(120)]
    rows = [(i, " ".join([*words[:60], f"edition{i}x", *words[60:]])) for i in range(100)] + [(i, " ".join(r.sample(words, 60))) for i in range(100, 110)]
    calls, real = [], simhash._hot_links
    monkeypatch.setattr(simhash, "_hot_links", lambda *a: calls.append(1) or real(*a))
    assert sorted(x["doc_id"] for x in simhash.keep_first(frame(spark, rows).repartition(3)).collect()) == [0, *range(100, 110)]
    assert len(calls) == 1


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (7, None), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


# 5


def test_rules_count_and_weigh(spark, docs, rows, empty):
    got = rules.score(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[x] > 1 for j in range(3)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        r = by[i][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert rules.score(empty).collect() == []


def test_expectation_maximisation_finds_the_accuracies():
    r = np.random.default_rng(5)
    good = r.random(20_000) < 0.8
    vote = np.where(r.random((20_000, 6)) < np.where(good[:, None], 0.05, 0.7), -1, np.where(r.random((20_000, 6)) < 0.1, 0, 1))
    patterns, counts = np.unique(vote, axis=0, return_counts=True)
    on_good, on_bad, share = rules.fit(patterns, counts)
    assert abs(share - 0.8) < 0.02 and np.abs(on_good[:, 0] - 0.05).max() < 0.02 and np.abs(on_bad[:, 0] - 0.7).max() < 0.03
    assert ((rules.posterior(vote, on_good, on_bad, share) > 0.5) == good).mean() > 0.98


# 6


def plain_repeats(rows, length=20):
    """A row is told apart by id and text; of rows with one id neither is earlier."""
    least, first = {}, {}
    key = lambda i: -1 if i is None else i
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            least[k] = min(key(i), least.get(k, key(i)))
            first[k, i, t] = min(p, first.get((k, i, t), p))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if least[k] < key(i) or first[k, i, t] < p:
                gone |= set(range(p, p + length))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def test_repeats_go_as_in_brute_force(docs, rows, empty):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substr.remove_repeats(docs).collect())
    assert got == Counter(plain_repeats(rows))
    sha = {r["kept"]: r["kept_sha256"] for r in substr.remove_repeats(docs).collect()}
    assert all(hashlib.sha256(k.encode()).hexdigest() == v for k, v in sha.items())
    assert substr.remove_repeats(empty).collect() == []


def test_repeats_with_ids_that_repeat_or_are_text(spark, rows):
    r = random.Random(21)
    own = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(n))
    shared = own(30)
    extra = [(5, own(30)), (5, own(10) + " " + shared), (5, shared + " " + own(40)), (2000, shared + " " + shared), (5, own(30))]
    table = [*rows, *extra, extra[1]]
    got = Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in substr.remove_repeats(frame(spark, table).repartition(5)).collect())
    assert got == Counter(plain_repeats(table)) and (5, 30, 0, extra[0][1]) in got
    named = [(None if i is None else f"{i:05d}/x", t) for i, t in table]
    docs = spark.createDataFrame(named, "doc_id string, text string").repartition(3)
    got = Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in substr.remove_repeats(docs).collect())
    assert got == Counter((None if i is None else f"{i:05d}/x", *rest) for i, *rest in plain_repeats(table))


def test_windows_of_hot_minimizers_meet_too(spark, monkeypatch):
    r = random.Random(22)
    words = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(300)]
    common = " ".join(words[:5])
    rows = [(i, " ".join(" ".join(r.choice(words) for _ in range(r.randint(6, 18))) + " " + common for _ in range(12))) for i in range(60)]
    rows += [(100 + i, rows[i][1][40:]) for i in range(20)]
    for name, value in (("SAMPLE", 1), ("HOT_SEGMENTS", 8)):
        monkeypatch.setattr(substr, name, value)
    docs = frame(spark, rows).repartition(3)
    assert len(substr.hot_minimizers(docs, 20))
    got = Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in substr.remove_repeats(docs).collect())
    assert got == Counter(plain_repeats(rows))


def test_index_counts_patterns():
    r = random.Random(2)
    text = np.array([r.randint(1, 4) for _ in range(500)] + [0], np.int32)
    index = FMIndex(text, 5, 6)
    ends = np.arange(5, 500)
    for often in (1, 2, 3):
        sizes, los = matching_statistics(index, text, ends, 6, np.full(len(ends), often), block=64)
        count = Counter(tuple(text[i : i + n]) for n in range(1, 7) for i in range(501 - n))
        for e, n in zip(ends, sizes, strict=True):
            assert n == max((k for k in range(1, 7) if count[tuple(text[e - k + 1 : e + 1])] >= often), default=0)
        seeded = matching_statistics(index, text, ends, 6, np.full(len(ends), often), seeded=True)
        assert np.array_equal(seeded[0], np.where(sizes < index.seeds[0], 0, sizes))
        full = sizes == 6
        assert len(set(zip(seeded[1][full], los[full], strict=True))) == len(set(los[full])) == len(set(seeded[1][full]))
    name = {}
    for e, n, lo in zip(ends, sizes, los, strict=True):
        if n == 6:
            assert name.setdefault(lo, tuple(text[e - 5 : e + 1])) == tuple(text[e - 5 : e + 1])


@pytest.mark.parametrize("seed", range(4))
def test_tree_ranks_and_suffixes(seed):
    r = np.random.default_rng(seed)
    sigma, n = int(r.integers(2, 400)), int(r.integers(1, 3000))
    text = r.choice(sigma, n, p=r.dirichlet(np.ones(sigma) * 0.1)).astype(np.int32)
    tree = WaveletTree(text, sigma)
    c = r.choice(text, 300)
    lo = r.integers(0, n + 1, 300)
    hi = np.maximum(lo, r.integers(0, n + 1, 300))
    a, b = tree.ranks(c, lo, hi)
    assert all(a[i] == (text[: lo[i]] == c[i]).sum() and b[i] == (text[: hi[i]] == c[i]).sum() for i in range(300))
    for depth in (1, 3, 20):
        suffixes = [tuple(text[i : i + depth]) for i in bounded_suffix_array(text, depth)[0]]
        assert suffixes == sorted(suffixes) and len(suffixes) == n


def test_segments_hold_every_window_once():
    raw = " ".join(str(random.Random(1).randint(0, 30)) for _ in range(300)).encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw) // 2, len(raw)]))
    first, stop, _ = substr.segments(words, 20)
    windows = [i for a, b in zip(first, stop, strict=True) for i in range(a, b - 19)]
    want = [i for t in (0, 1) for i in range(words.bounds[t], words.bounds[t + 1] - 19)]
    assert windows == want


# 7


def test_recurring_lines_go_but_copies_stay(spark, empty):
    r = random.Random(6)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    rows = [(i, f"{text()}\nPosted by user{i} on day {i * 3}\n{text()}\nAll rights of this page are with its owner {r.choice(['Ann', 'Bob', 'Cy'])} and the publishing house behind it\n{text()}") for i in range(20)]
    whole = "\n".join(text() for _ in range(6))
    rows += [(100 + i, whole) for i in range(20)] + [(200, None), (201, ""), (202, "\n\n"), (None, rows[3][1]), (5, rows[5][1])]
    docs = frame(spark, rows)
    out = lines.drop_recurring_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {x["doc_id"]: x["text"] for x in out.collect() if x["doc_id"] is not None}
    assert got[0] == rows[0][1]  # the first document keeps the lines
    for i in range(1, 20):
        a, _, b, _, c = rows[i][1].split("\n")
        assert got[i] == "\n".join((a, b, c))
    assert all(got[100 + i] == whole for i in range(20))
    assert got[200] is None and got[201] == "" and got[202] == "\n\n"
    report = {x["doc_id"]: (x["n_lines"], x["n_dropped"]) for x in lines.line_report(docs).collect()}
    assert report[7] == (5, 2) and report[200] == (0, 0) and report[202] == (0, 0)
    assert lines.drop_recurring_lines(empty).collect() == [] and lines.line_report(empty).collect() == []


def test_blocks_of_lines_go_from_unrelated_texts(spark):
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    short, long, pair = [text(4) for _ in range(4)], [text(15) for _ in range(3)], [text(5), text(6)]
    own = lambda: [text(30) for _ in range(4)]
    rows = [(i, own() + short + own()) for i in range(20)]
    rows += [(100 + i, own() + long + own()) for i in range(6)]  # too few for short lines
    rows += [(200 + i, own() + pair) for i in range(12)]  # a footer
    rows += [(300 + i, own() + short[:2] + own()) for i in range(3)]
    near = [text(20) for _ in range(30)]
    rows += [(400 + i, near[:i] + [text(20)] + near[i + 1 :]) for i in range(12)]
    got = {x["doc_id"]: x["text"].split("\n") for x in lines.drop_recurring_lines(frame(spark, [(i, "\n".join(t)) for i, t in rows])).collect()}
    block = {*short, *long, *pair}
    for i, t in rows:
        assert got[i] == (t if i in (0, 100, 200) else [x for x in t if x not in block]), i


def test_fields_anywhere_share_a_template(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    kinds = [
        lambda: f"Posted by {word()} in {word()}",
        lambda: f"Share this with {word()}",
        lambda: f"This page was last changed by {word()} of our staff and is shown as it was sent by {word()} to us",
    ]
    rows, plain = [], set()
    for i in range(15):
        made = [k() for k in kinds]
        # lines with the same leading words that share nothing else stay
        own = [text(25), f"Posted by {text(6)}", text(25), text(3)]
        plain |= set(own) | (set(made) if i == 0 else set())
        rows.append((i, "\n".join([own[0], made[0], own[1], made[1], own[2], made[2], own[3]])))
    got = {x["doc_id"]: x["text"].split("\n") for x in lines.drop_recurring_lines(frame(spark, rows)).collect()}
    for i, t in rows:
        assert got[i] == [x for x in t.split("\n") if x in plain], i


# 8


def test_packing_is_whole_exact_and_tight(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, size=64, open_windows=4, min_piece=4).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids)] += 1
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0) == want
    texts = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    total = Counter()
    for p in pieces:
        part = texts[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"]
        total[p["doc_id"]] += p["length"]
    assert total == Counter({i: sum(n * c for (j, n), c in want.items() if j == i) for i in texts})
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    fill = []
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
        fill.append(at)
    assert sum(0 if n & (n - 1) == 0 else 64 - n for n in fill) < 0.06 * sum(fill)
    assert packing.pack(empty, path).collect() == []


def test_ids_are_the_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.Encoder(path)
    r = random.Random(8)
    bits = [*"ab Z9é'ß\n\t .,!'s ñ漢😀|<>#\u0085\u00a0\u200b", "<|endoftext|>", "'ll", "  ", "\r\n", "\x1c"]
    for _ in range(800):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 40)))
        want = np.array(encoder.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == want and (not text or encoder._piecewise(text) == want)


# 9

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(t):
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(s))


def test_secret_spans(spark, empty):
    r = random.Random(7)
    bits = ["password=", "secret : '", 'API_KEY":"', "token", "=", " ", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", "\n", "x", "ſecret=abcdefgh", ".", "KEY"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))) for i in range(150)]
    shown, own = "Zq7Rt5Yb3Nm1Kx9Wv2Lp8Hd4", "Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8"
    rows += [(1000 + i, f"see {shown} here") for i in range(8)] + [(1100, f"my {own}."), (1200, None), (1201, ""), (None, "token=abcdefghi"), (1, rows[1][1]), (1, "token=123456789")]
    docs = frame(spark, rows)
    out = secrets.scan(docs)
    base = F.filter("spans", lambda s: s["rank"] < 3)
    got = [(x["doc_id"], x["d"]) for x in out.select("doc_id", secrets.digest_of(base).alias("d")).collect()]
    assert Counter(got) == Counter((i, plain_spans(t or "")) for i, t in rows)
    spans = {x["doc_id"]: x["spans"] for x in out.where("doc_id >= 1000").collect()}
    assert [s["kind"] for s in spans[1100]] == ["mixed"] and spans[1100][0]["live"] and spans[1000] == []
    assert secrets.scan(empty).collect() == []


# 10


def test_url_rules(spark):
    rules_ = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "/e", "allow"), (None, "/", "block"), ("net", "/es/", "block")]
    known = spark.createDataFrame(rules_, "host string, path string, verdict string")
    urls_ = ["http://www.Example.com/en/1?x", "https://blog.example.com/en/", "ftp://example.com", "http://example.com/EN/", "http://x.a.net/es/1#f", "http://b.net/es/", "http://b.net/es", "nothing", None, "http:///es/", "http://net/es/?a://b", "x://y://z/", "http://com?u/en/", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls_)] + [(0, urls_[0], "h", "p")], "page_id long, url string, host string, path string")
    got = Counter(map(tuple, urls.judge(pages, known).select("page_id", "host", "path", "rule", "verdict").collect()))
    want = Counter()
    for i, u in [*enumerate(urls_), (0, urls_[0])]:
        rest = re.match(r"[^?#]*", (u or "").partition("://")[2])[0] if "://" in (u or "") else ""
        host, slash, tail = rest.partition("/")
        host, path = host.lower(), slash + tail
        fits = [(len(h) + len(p), len(h), v == "allow", h + p, v) for h, p, v in rules_ if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else None
        want[i, host, path, best[3] if best else None, best[4] if best else "allow"] += 1
    assert got == want
    assert urls.judge(pages.limit(0), known).collect() == []
    assert {r["verdict"] for r in urls.judge(pages, known.limit(0)).collect()} == {"allow"}


def test_share_of_like_siblings_at_every_size():
    for n in (40, 80):
        page = htmltext.Page("<html><body>" + "<p>Some words, and more of them.</p>" * n + "<div>advert</div></body></html>")
        x = htmltext.node_features(page)
        same = x[:, -3]
        kids = [i for i, t in enumerate(page.tag) if t in ("p", "div")]
        assert len(kids) == n + 1
        assert np.allclose(same[kids], [(n if page.tag[i] == "p" else 1) / (n + 1) for i in kids])


def test_examples_of_one_hot_source_are_no_credentials(spark):
    shown, own = "Zq7Rt5Yb3Nm1Kx9Wv2Lp8Hd4", "Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8"
    rows = [(i, f"see {shown} here", "hot") for i in range(60)] + [(100 + i, f"my {own}.", "hot") for i in range(3)]
    got = {x["doc_id"]: x["spans"] for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == [] for i in range(60)) and all([s["live"] for s in got[100 + i]] == [True] for i in range(3))
