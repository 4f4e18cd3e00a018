"""Toxicity, URL rules and decontamination."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import decontaminate as D
from shardloom.llm import toxicity as X
from shardloom.llm import url_rules as U


def labelled(n, rng):
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(800)]
    texts, labels = [], []
    for i in range(n):
        own = rng.choices(words, k=60)
        low, bad = i % 4 == 0, i % 5 == 0
        if low:
            own += ["buynow", "clickhere"]
        if bad:
            own[3] = rng.choice(["vilea", "vileb", "vilec"])
        texts.append(" ".join(own))
        labels.append((int(low), int(bad)))
    return texts, np.array(labels)


def test_chain_on_held_out_texts():
    rng = random.Random(1)
    texts, labels = labelled(1200, rng)
    model = X.train(texts[:800], labels[:800])
    chain = X.Chain(model)
    p = np.array([chain(t) for t in texts[800:]])
    assert ((p >= 0.5) == labels[800:]).mean() > 0.98
    assert len(model["links"][1]["before"]) == 1 and chain("")[1] < 0.5


def test_later_links_use_earlier_ones():
    rng = random.Random(2)
    texts, labels = labelled(900, rng)
    labels[:, 1] = labels[:, 0]  # the second category follows from the first
    assert X.train(texts, labels)["links"][1]["before"][0] > 0


def test_toxicity_frames(spark):
    texts, labels = labelled(400, random.Random(3))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, p_toxic string")
    known = spark.createDataFrame([(i, 1 - int(a), int(b)) for i, (a, b) in enumerate(labels.tolist())] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = X.fit_chain(spark, docs, known, X.categories())
    out = {r.doc_id: r for r in X.score(spark, docs, model).collect()}
    right = sum((out[i].p_toxic >= X.REJECT) == bool(y) for i, y in enumerate(labels[:, 1].tolist()))
    assert right >= 396 and out[400].p_toxic == out[401].p_toxic < 0.5
    nothing = X.fit_chain(spark, docs, known.limit(0), X.categories())
    assert all(r.p_toxic < 1e-6 for r in X.score(spark, docs, nothing).collect())
    assert X.score(spark, docs.limit(0), model).count() == 0


URLS = {
    "https://a.Example.COM/en/7?x#y": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "http://com/en/": ("com", "/en/", "com/en/", "block"), "http://xcom/en/": ("xcom", "/en/", None, "allow"),
    "http://example.net/de/8/": ("example.net", "/de/8/", "example.net/de/8", "block"), "ftp://x.net/de/1": ("x.net", "/de/1", "net/de/", "allow"), "http://b.org/es": ("b.org", "/es", None, "allow"), "http://b.org/es/": ("b.org", "/es/", "org/es/", "block"),
    "http://h?q=://z/": ("h", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http:///p": ("", "/p", None, "allow"), "x://É.com\n/en/": ("É.com\n", "/en/", None, "allow"),
}


def test_explicit_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    out = {r.url: (r.host, r.path, r.rule, r.verdict) for r in U.url_filter(spark, pages, spark.createDataFrame([], "doc_id long, bad boolean")).collect()}
    assert out == URLS


def test_mined_rules_against_counting(spark):
    rng = random.Random(4)
    pages, labels = [], []
    for i in range(300):
        url = f"http://{rng.choice(['aa', 'bb', 'cc'])}.{rng.choice(['org', 'info'])}/{rng.choice(['x', 'y', 'z'])}/{i}"
        pages.append((i, url))
        labels.append((i, ("bb" in url and "/y/" in url) or rng.random() < 0.1))
    labels += [(0, None), (9999, True)]
    p, y = spark.createDataFrame(pages + [(0, pages[0][1])], "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad boolean")
    out = U.url_filter(spark, p, y, 0.02, 0.7).collect()
    assert len(out) == 301
    known: dict[int, bool] = {}
    for i, b in labels:
        known[i] = known.get(i, False) or bool(b)
    own = [(frozenset("0" if t.isdigit() else t for t in u.replace(":", "/").replace(".", "/").split("/") if t), known[i]) for i, u in pages + [(0, pages[0][1])]]
    rules = {}
    for k in range(1, 7):
        for tokens in {c for t, _ in own for c in combinations(sorted(t), k)}:
            has = [b for t, b in own if set(tokens) <= t]
            if sum(has) >= 0.02 * len(own) and sum(has) / len(has) >= 0.7:
                rules[frozenset(tokens)] = sum(has) / len(has)
    for r in out:
        tokens = frozenset("0" if t.isdigit() else t for t in r.url.replace(":", "/").replace(".", "/").split("/") if t)
        best = max((c for s, c in rules.items() if s <= tokens), default=None)
        assert (r.verdict == "block") == (best is not None) and (best is None or abs(r.confidence - best) < 1e-9)


def plain_distance(item, window):
    row = [0] * (len(window) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(window, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_distance():
    rng = random.Random(3)
    for _ in range(300):
        a, w = ("".join(rng.choices("abc", k=rng.randrange(k))) for k in (20, 40))
        a += "a"
        d = plain_distance(a, w)
        assert D.distance(a, w, 100) == d
        near = D.distance(a, w, 2)
        assert near == d if d <= 2 else near > 2


def passages(rng, n=30):
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(500)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    return [say(40) for _ in range(n)], say


@pytest.mark.parametrize(("rate", "least"), [(0.0, 1.0), (0.05, 1.0), (0.1, 0.93)])
def test_recall_and_clean_documents(spark, rate, least):
    rng = random.Random(9)
    items, say = passages(rng)
    docs = [(i, say(rng.randrange(80)) + " " + D.edited(t.upper() if i % 2 else t, rate, rng) + "\n\n" + say(rng.randrange(80))) for i, t in enumerate(items)]
    docs += [(100 + i, say(200)) for i in range(60)] + [(200, None), (201, ""), (None, items[0]), (7, docs[7][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(90, None, "x"), (91, "too short", "x"), (92, "", "x")], "item_id long, text string, doc_id string")
    got = [(r.doc_id, r.item_id, r.distance) for r in D.contaminated(spark, df, bench).collect()]
    hit = {(d, i) for d, i, _ in got}
    assert len({d for d, i in hit if d == i}) >= least * len(items) and not {d for d, _ in hit if d is not None and d >= 100} and (None, 0) in hit
    text = dict((d, t) for d, t in docs if d is not None)
    for d, i, n in got:
        if d is not None:
            assert n == plain_distance(D.plain(items[i]), D.plain(text[d]))
    clean = D.uncontaminated(spark, df, bench).collect()
    assert {r.doc_id for r in clean} == {d for d, _ in docs} - {d for d, _ in hit} and len(clean) == 62


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(spark, df, none).count() == 0 and D.uncontaminated(spark, df, none).count() == 1
    some = spark.createDataFrame([(1, "some words that are long enough to be an item")], "item_id long, text string")
    assert D.contaminated(spark, df.limit(0), some).count() == 0


def test_item_groups(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_ITEM_CHARS", 2000)
    items, _ = passages(random.Random(5), 12)
    df = spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")
    bench = df.select(F.col("doc_id").alias("item_id"), "text")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(spark, df, bench).collect()} == {(i, i) for i in range(12)}


@pytest.mark.parametrize("n", [3, 9, 20, 31, 32, 37, 42, 50, 63])
def test_short_items_are_found_wherever_they_stand(n):
    rng = random.Random(n)
    some = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    items, most = [some(n) for _ in range(6)], int(D.WITHIN * n)
    search = D.Search(items, D.repeats_for(items), D.WITHIN)
    copies = [items[i % 6] if i < 12 else D.edited(items[i % 6], rng.random() * D.WITHIN, rng) for i in range(48)]
    texts = [some(i) + c + some(50) for i, c in enumerate(copies)] + [some(200), ""]
    want = {(k, i): d for k, t in enumerate(texts) for i, x in enumerate(items) if (d := plain_distance(x, t)) <= most}
    assert search(texts) == want and {(i, i % 6) for i in range(12)} <= set(want)


def test_recall_is_met_at_the_limit_in_each_class():
    rng = random.Random(12)
    _, say = passages(rng)
    for n in (64, 100, 130, 200, 330):
        items = [say(80)[:n].strip() for _ in range(40)]
        repeats = D.repeats_for(items)
        search = D.Search(items, repeats, 1.2 * D.WITHIN)  # room for rounding
        texts = [say(rng.randrange(20)) + " " + D.edited(t, D.WITHIN, rng) + " " + say(20) for _ in range(5) for t in items]
        found = search(texts)
        assert sum((k, k % 40) in found for k in range(len(texts))) >= 0.94 * len(texts), (n, repeats)


def test_classes_out_of_reach_go_the_exact_way():
    items = [passages(random.Random(13))[0][0][:150].strip()]
    assert D.repeats_for(items, most=0) == [0] and D.repeats_for(items)[0] > 0
    assert D.Search(items, [0], D.WITHIN)(["x" * 7 + items[0], "y" * 300]) == {(0, 0): 0}


def test_bounds_of_many_windows():
    """Over texts whose bytes are all their own, the bound is the distance."""
    rng = random.Random(21)
    some = lambda k: "".join(rng.choices("abcdefg ", k=k))
    items = [some(n) for n in (1, 5, 63, 64, 65, 128, 130, 200)]
    text = some(900)
    codes = np.concatenate([D.codes(text), np.zeros(D.ROOM, np.uint8)])
    where = [(i, lo, min(900, lo + rng.randrange(1, 2 * len(items[i]) + 20))) for i in range(len(items)) for lo in (rng.randrange(800) for _ in range(9))]
    item, lo, hi = np.array(where).T
    assert D.Bounds(items)(item, lo, hi, codes).tolist() == [plain_distance(items[i], text[a:b]) for i, a, b in where]
    # characters that share a byte can only lower it
    odd = "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(300))
    low = D.Bounds([odd[50:120], odd[:40]])(np.array([0, 1]), np.array([60, 30]), np.array([190, 90]), np.concatenate([D.codes(odd), np.zeros(D.ROOM, np.uint8)]))
    assert low[0] <= plain_distance(odd[50:120], odd[60:190]) and low[1] <= plain_distance(odd[:40], odd[30:90])


def test_against_all_pairs(spark):
    """Every pair of document and item within the limit, by plain distances over whole texts, against what the operator finds."""
    rng = random.Random(31)
    items, say = passages(rng, 24)
    items = [t[: rng.randrange(20, 200)].strip() for t in items]
    texts = [say(rng.randrange(30)) + " " + D.edited(items[i % 24], rng.choice([0, 0.05, 0.1, 0.15, 0.2]), rng) + " " + say(rng.randrange(30)) for i in range(240)] + [say(60) for _ in range(30)]
    want = {(k, i): d for k, t in enumerate(texts) for i, x in enumerate(items) if (d := plain_distance(D.plain(x), D.plain(t))) <= int(D.WITHIN * len(x))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*enumerate(items), (70, items[0])], "item_id long, text string")
    rows = D.contaminated(spark, df, bench).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in rows if r.item_id != 70}
    assert got.items() <= want.items() and len(got) >= 0.97 * len(want) and len(rows) == len(got) + sum(i == 0 for _, i in got)


def test_long_families_do_not_multiply(spark):
    """30 tokens that always stand together would make 2**30 frequent sets; any one of them tells new pages as well as all."""
    long = "/".join(f"part{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(30))
    pages = [(i, f"http://a.org/{long}/{i}") for i in range(60)] + [(100 + i, f"http://b.org/fine/{i}") for i in range(60)] + [(900, "http://c.net/partc/1"), (901, "http://c.net/else/1")]
    labels = [(i, True) for i in range(60)] + [(100 + i, False) for i in range(60)]
    p, y = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad boolean")
    out = {r.page_id: r.verdict for r in U.url_filter(spark, p, y, 0.02, 0.7).collect()}
    assert out == {i: "block" if i < 60 or i == 900 else "allow" for i, _ in pages}
