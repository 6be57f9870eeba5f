"""Operators over whole tables, against plain versions on small ones."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kotonoha.llm import components, langmix, linefreq, mixing, neighbours, partenum, spread
from tests.llm.conftest import ODD

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in "".join(" " if c in BLANKS else c for c in text or "").split(" ") if w]


def normal(line):
    return " ".join(words_of(line)).lower()


# Language mixtures

def test_proportions_and_choice_of_languages(spark, documents, prose):
    kinds = ("aa", "bb", "cc")
    rows = [(i, prose(k, 200), k, "s") for i, k in enumerate(kinds * 12)]
    settings = langmix.Mixture()
    labels, shares = langmix.fit(documents(rows), settings)
    assert labels == list(kinds) and np.allclose(shares.sum(1), 1, atol=1e-6)
    for kind in kinds:
        found = langmix.proportions(prose(kind, 150), shares, settings)
        assert found[labels.index(kind)] == 1.0
    both = langmix.proportions(prose("aa", 300) + "\n" + prose("bb", 100), shares, settings)
    assert 0.6 < both[0] < 0.9 and both[1] > 0.1 and both[2] == 0 and abs(both.sum() - 1) < 1e-9
    odd = documents([(i, t, None, None) for i, t in enumerate(ODD)] + [(None, prose("cc", 50), None, None)] * 2)
    out = langmix.identify(odd, labels, shares, settings).collect()
    assert len(out) == len(ODD) + 2
    by_id = {r["doc_id"]: r for r in out}
    for i in (0, 1, 2, 3, 6, 8, 15, 16):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["languages"]) == ("und", 0.0, [])
    assert by_id[None]["lang_pred"] == "cc" and all(0 <= r["score"] <= 1 for r in out)
    nothing = langmix.fit(documents([]), settings)
    assert nothing[0] == [] and {r["lang_pred"] for r in langmix.identify(odd, *nothing, settings).collect()} == {"und"}


def test_learning_from_broken_utf8(spark, documents, prose):
    df = documents([(i, prose("aa", 50), "aa", "s") for i in range(4)])
    broken = df.withColumn("text", F.when(F.col("doc_id") == 1, F.expr("cast(X'61FF62' AS string)")).otherwise(F.col("text")))
    labels, shares = langmix.fit(broken, langmix.Mixture())
    assert labels == ["aa"] and {r["lang_pred"] for r in langmix.identify(broken, labels, shares, langmix.Mixture()).collect()} == {"aa"}


def test_expectation_maximisation_climbs():
    rnd = np.random.default_rng(3)
    likely, counts = rnd.dirichlet(np.ones(40), 3).T, rnd.integers(1, 9, 40).astype(float)
    exact = langmix.Mixture(rounds=5000, tolerance=1e-12)
    share, best = langmix.maximise(likely, counts, np.ones(3) / 3, exact)
    grid = [(a, b, 1 - a - b) for a in np.arange(0, 1.01, 0.02) for b in np.arange(0, 1.01 - a, 0.02) if a + b <= 1]
    assert best >= max(float(counts @ np.log(likely @ np.array(g) + 1e-300)) for g in grid) - 1e-6
    assert abs(share.sum() - 1) < 1e-9


# Quality rules

def plain_lines(rows):
    """Documents of every (host, line), and the smallest id among them."""
    has = defaultdict(set)
    for i, text, host in {(i, t or "", s or "") for i, t, _, s in rows}:
        for line in {normal(x) for x in text.split("\n")} - {""}:
            has[host, line].add((i, text))
    return has, {k: min((i for i, _ in of if i is not None), default=None) for k, of in has.items()}


def plain_quality(rows, limits):
    has, keeper = plain_lines(rows)
    out = {}
    for i, t, _, s in rows:
        text, host = t or "", s or ""
        ws = words_of(text)
        seen = defaultdict(list)
        for k in range(len(ws) - 2):
            seen[tuple(ws[k:k + 3])].append(k)
        repeated = {p + d for places in seen.values() if len(places) > 1 for p in places for d in range(3)}
        filled = [x for x in text.split("\n") if words_of(x)]
        own = [normal(x) for x in filled]
        gone = sum(len(x.split(" ")) for x in own if len(has[host, x]) > limits.documents and keeper[host, x] != i)
        failed = len(ws) < limits.words or 100 * len(repeated) > limits.repeated * len(ws)
        whole = sum(len(x.split(" ")) for x in own)
        out[i, text] = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(filled) - len(set(filled)),
                        len(repeated), failed, gone, not failed and 100 * (whole - gone) >= limits.remaining * whole)
    return out


@pytest.fixture(scope="module")
def lined(prose):
    rnd = random.Random(9)
    pool = [prose("aa", rnd.randint(3, 12)) for _ in range(8)]
    rows = []
    for i in range(90):
        lines = [prose("aa", rnd.randint(1, 20)) for _ in range(rnd.randint(0, 4))] + rnd.choices(pool, k=rnd.randint(0, 5))
        lines += [" " + lines[0].upper()] if lines and rnd.random() < 0.2 else []
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), "aa", rnd.choice(["s1", "s1", "s2", "s3", None])))
    rows += [(200 + i, rows[3][1], "aa", "s1") for i in range(4)]
    return rows + [(300 + i, t, None, "s2") for i, t in enumerate(ODD)] + [(None, rows[5][1] + "\nmore", None, "s1")]


def test_quality_equals_plain(documents, lined):
    limits = linefreq.Limits(documents=4, words=8)
    expected = plain_quality(lined, limits)
    df = documents([*lined, lined[7]])
    out = linefreq.judge(df, limits).collect()
    texts = {i: t or "" for i, t, _, _ in lined}
    assert len(out) == len(lined) + 1
    for r in out:
        assert tuple(r)[1:] == expected[r["doc_id"], texts[r["doc_id"]]], r
    assert sum(r["kept"] for r in out) not in (0, len(out)) and any(r["removed_words"] for r in out)
    kept = linefreq.reject(df, limits)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in out if r["kept"])
    assert linefreq.judge(df.limit(0)).count() == 0 and linefreq.reject(df.limit(0)).count() == 0


def plain_removal(rows, limits):
    """Ids and texts of the rows, without the frequent lines of their hosts."""
    has, keeper = plain_lines(rows)

    def stays(key, i):
        return len(has[key]) <= limits.documents or keeper[key] == i

    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if not normal(x) or stays((s or "", normal(x)), i)))
            for i, t, _, s in rows]


def test_removal_equals_plain(documents, lined):
    limits = linefreq.Limits(documents=4, words=8)
    rows = [*lined, lined[7]]
    df, expected = documents(rows), plain_removal(rows, limits)
    out = linefreq.remove_frequent(df, limits)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(expected, key=str)
    assert sum(t != r[1] for (_, t), r in zip(expected, rows)) > 30
    verdicts = plain_quality(rows, limits)
    kept = [x for x, (i, t, _, _) in zip(expected, rows) if verdicts[i, t or ""][-1]]
    assert sorted(((r["doc_id"], r["text"]) for r in linefreq.reject(df, limits).collect()), key=str) == sorted(kept, key=str)
    assert linefreq.remove_frequent(df.limit(0), limits).count() == 0


def test_quality_stage_takes_a_line_of_one_host(spark, documents, prose):
    rows = [(i, "\n".join([prose("aa", 40), "Footer of  the host", "", prose("bb", 40), "footer of the host "]), "aa", "s1")
            for i in range(12)]
    rows += [(50 + i, prose("cc", 60) + "\nfooter of the host", "cc", "s2") for i in range(10)]  # at the limit
    out = corpus_pipeline.quality_rules(spark, documents(rows), "").collect()
    assert {r["doc_id"]: r["text"] for r in out} == dict(plain_removal(rows, linefreq.Limits()))
    assert [sum("footer" in r["text"].lower() for r in out if r["source"] == s) for s in ("s1", "s2")] == [1, 10]
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_copies_count_as_documents(documents, prose):
    text = prose("aa", 60) + "\n" + prose("bb", 60)
    rows = [(i, text, "aa", "s1") for i in range(12)] + [(40 + i, text, "aa", "s2") for i in range(10)]
    rows += [(101 + i, f"footer line\n{prose('cc', 60)}", "cc", "s3") for i in range(11)]
    rows += [(200, prose("cc", 70) + "\nfooter line" * 90, "cc", "s3")]
    found = {r["doc_id"]: r for r in linefreq.judge(documents(rows + rows[12:22])).collect()}
    assert [i for i in range(12) if found[i]["kept"]] == [0] and all(found[40 + i]["kept"] for i in range(10))
    assert [found[i]["removed_words"] for i in (101, 102, 200)] == [0, 2, 180]  # every place of the line


def test_repeated_words_of_a_long_text(documents):
    text = "a b c d " * 20000 + " ".join(f"w{i}" for i in range(30000))
    row = linefreq.judge(documents([(1, text, "aa", "s")])).head()
    assert row["n_repeat_words"] == 80000 and row["n_words"] == 110000 and row["base_failed"]


# Site spread

def plain_spread(rows, settings):
    sites, keeper = defaultdict(set), {}
    for i, t, _, s in rows:
        for line in (t or "").split("\n"):
            n = normal(line)
            if n:
                if s is not None:
                    sites[n].add(s)
                if i is not None:
                    keeper[n] = min(keeper.get(n, i), i)
    out = []
    for i, t, _, s in rows:
        left = [x for x in (t or "").split("\n")
                if not normal(x) or len(sites[normal(x)]) < settings.sites or keeper.get(normal(x)) == i]
        out.append((i, None if t is None else "\n".join(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sites", [1, 2, 3])
def test_spread_equals_plain(documents, lined, sites):
    settings = spread.Spread(sites=sites)
    df = documents([*lined, lined[7]])
    out = spread.remove_boilerplate(df, settings)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == plain_spread([*lined, lined[7]], settings)
    assert spread.remove_boilerplate(df.limit(0), settings, counts=True).count() == 0


def test_spread_far_above_the_threshold(documents):
    rows = [(i, "one common line here\nown line number %d" % i, None, f"s{i % 60}") for i in range(240)]
    out = spread.remove_boilerplate(documents(rows), spread.Spread(sites=10), counts=True).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {i: int(i > 0) for i in range(240)}


# Jaccard join

def plain_components(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def copied(prose):
    """Texts and copies with some words changed; many of them near the threshold."""
    rnd = random.Random(11)
    rows = []
    for base in range(14):
        words = prose("bb", rnd.choice([2, 5, 9, 20, 60, 150, 300])).split()
        for _ in range(rnd.choice([1, 3, 12, 25])):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = prose("cc", 1)
            rows.append((len(rows), " ".join(copy[rnd.randint(0, 1):]), None, None))
    rows += [(1000 + k, rows[0][1].upper(), None, None) for k in range(3)]
    return rows + [(2000 + k, t, None, None) for k, t in enumerate(ODD)]


@pytest.mark.parametrize("join", [
    partenum.Join(), partenum.Join(size=5, percent=80), partenum.Join(percent=70, subset=2, apart=1, block=5),
    partenum.Join(percent=90, slack=1.0, block_shingles=500, bucket=2), partenum.Join(percent=100)])
def test_join_equals_plain(documents, copied, join):
    expected = plain_components(copied, join.size, join.percent)
    df = documents([*copied, copied[3], (None, copied[0][1], None, None)])
    out = partenum.near_duplicates(df, join).collect()
    assert len(out) == len(copied) + 2
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == expected[0][0]
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]], r
    kept = {r["doc_id"] for r in partenum.keep_one(df, join).collect()}
    assert kept - {None} == {i for i, (_, c) in expected.items() if i == c}
    assert partenum.near_duplicates(df.limit(0), join).count() == 0


def test_one_row_of_each_group_stays(documents, prose):
    a, b, c, d = (prose("aa", 80) for _ in range(4))
    rows = [(1, a, None, None), (2, a, None, None), (2, b, None, None), (3, b, None, None),  # 2 loses a, but keeps b
            (4, c, None, None), (4, c, None, None), (4, c.upper(), None, None), (5, c, None, None),  # one row of three
            (6, d + " x", None, None), (6, d, None, None), (7, d, None, None),  # one of two linked texts of an id
            (8, "", None, None), (8, None, None, None), (None, a, None, None)]
    df = documents(rows)
    out = partenum.keep_one(df)
    assert out.columns == df.columns
    found = Counter((r["doc_id"], (r["text"] or "").lower()) for r in out.collect())
    assert found.pop((6, d), 0) + found.pop((6, d + " x"), 0) == 1
    assert found == {(1, a): 1, (2, b): 1, (4, c): 1, (8, ""): 2, (None, a): 1}


def test_linked_sets_share_a_signature():
    rnd = np.random.default_rng(7)
    for percent, subset, apart in ((90, 1, 0), (80, 1, 0), (80, 2, 1), (60, 1, 2)):
        join = partenum.Join(percent=percent, subset=subset, apart=apart)
        for _ in range(400):
            n = int(rnd.integers(1, 400))
            a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
            change = int(rnd.integers(0, max(1, n * (100 - percent) // 100) + 1))
            b = np.unique(np.concatenate([a[int(rnd.integers(0, change + 1)):], rnd.integers(0, 1 << 62, change).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
                assert np.intersect1d(partenum.signatures(a, join), partenum.signatures(b, join)).size
                of_b = {p["band"]: p["cells"] for p in partenum.profiles(b, join)}
                common = [(p["cells"], of_b[p["band"]]) for p in partenum.profiles(a, join) if p["band"] in of_b]
                assert common
                for x, y in common:
                    seen = np.frombuffer(x + y, np.uint8).reshape(2, -1)
                    assert partenum.alike(np.array([len(a), len(b)]), seen, join) == [(0, 1)]


def test_components_of_graphs(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    edges += [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in found} == {x: find(x) for x in root}
    assert len(found) == len(root)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Nearest examples

def test_search_is_exact():
    rnd = random.Random(4)
    vectors = []
    for _ in range(700):
        raw = {t: rnd.choice([1.0, 1.0, 2.0]) for t in rnd.sample(range(30), rnd.randint(0, 6))}
        length = math.sqrt(sum(w * w for w in raw.values())) or 1
        vectors.append({t: w / length for t, w in raw.items()})
    settings = neighbours.Neighbours(block=16)
    index = neighbours.Index(vectors, [i % 3 == 0 for i in range(700)], list(range(700)), 30, settings)
    for query in vectors[:200]:
        places, cosines = index.search(query, 10)
        scores = sorted(((-round(sum(w * vectors[i].get(t, 0) for t, w in query.items()), 12), p)
                         for p, i in enumerate(index.ids)), key=lambda x: x)
        scores = [s for s in scores if s[0] < 0][:10]
        assert list(places) == [p for _, p in scores]
        assert np.allclose(cosines, [-c for c, _ in scores], atol=1e-9)
    without = index.search(vectors[5], 700, leave_out=3)[0]
    assert 3 not in without


@pytest.fixture(scope="module")
def marked(documents, prose):
    rnd = random.Random(12)
    rows, labels = [], []
    for i in range(160):
        words = prose("aa", 60).split()
        toxic = i % 4 == 0
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["scoundrel", "rascal", "villain"]))
        poor = not toxic and i % 7 == 0
        rows.append((i, " ".join(w + "!!" if poor else w for w in words).upper() if poor else " ".join(words), "aa", "s"))
        labels.append((i, int(not poor), int(toxic)))
    return documents(rows), labels


def test_scores_of_unseen_texts(spark, documents, marked, prose):
    docs, labels = marked
    table = spark.createDataFrame([*labels, labels[0], (9999, 1, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    known = table.where(F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)))
    model = neighbours.fit(docs, known, neighbours.Neighbours())
    out = {r["doc_id"]: r for r in neighbours.score(docs, model).collect()}
    for i, _, toxic in labels:
        assert (out[i]["score"] >= 0.5) == bool(toxic) == bool(out[i]["predicted"])
        assert 0 <= out[i]["score"] <= 1
    assert out[0]["evidence"] and all(e["toxic"] == 1 for e in out[0]["evidence"])
    odd = documents([(i, t, None, None) for i, t in enumerate(ODD)] * 2)
    scored = neighbours.score(odd, model).collect()
    assert len(scored) == 2 * len(ODD) and all(r["score"] < 0.5 and r["evidence"] == [] for r in scored)
    empty = neighbours.fit(docs.limit(0), table.limit(0), neighbours.Neighbours())
    assert {r["score"] for r in neighbours.score(odd, empty).collect()} == {0.0}


# Mixing

def test_rates_reach_the_targets(spark, documents, marked):
    docs, labels = marked
    table = mixing.labelled_domains(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    extra = documents([(500 + i, t, None, None) for i, t in enumerate(ODD)])
    df = docs.unionByName(extra)
    out = mixing.mix(df, table, ["good", "poor", "toxic"], [0.8, 0.15, 0.05]).collect()
    assert len(out) == 160 + len(ODD)
    total = sum(r["n_tokens"] for r in out)
    for d, weight in enumerate([0.8, 0.15, 0.05]):
        assert abs(sum(r["n_tokens"] * r["p"][d] * r["rate"] for r in out) / total - weight) < 2e-3
    for r in out:
        assert r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-6 and math.floor(r["rate"]) <= r["copies"] <= r["rate"] + 1
    by_id = {r["doc_id"]: r for r in out}
    assert sum(by_id[i]["p"][2] > 0.5 for i, _, toxic in labels if toxic) >= 38
    capped = mixing.mix(df, table, ["good", "poor", "toxic"], [1.1, 1.1, 0.0], most=1.0, relative=True).collect()
    assert all(0 <= r["rate"] <= 1 for r in capped)
    assert sum(r["copies"] for r in capped if r["doc_id"] in {i for i, q, x in labels if x}) < 8
    assert all(r["copies"] for r in capped if r["doc_id"] in {i for i, q, x in labels if q and not x})
    assert mixing.mix(df.limit(0), table, ["good", "poor"], [0.5, 0.5]).count() == 0


def test_projected_gradient_equals_plain(spark):
    rnd = np.random.default_rng(5)
    n, p = rnd.integers(1, 90, 60), rnd.dirichlet([0.4] * 3, 60)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    targets = np.array([0.5, 0.35, 0.15]) * n.sum()
    settings = mixing.Mixing(rounds=60, tolerance=1e-6)
    steps = mixing.fit_rates(members, targets, settings)
    rates = np.array([r[0] for r in members.select(mixing.after(steps, None)).collect()])
    assert (rates >= 0).all() and np.allclose((n * rates) @ p, targets, rtol=5e-3)
    plain = np.ones(60)
    for _ in steps:
        plain = np.maximum(0, plain - p @ (((n * plain) @ p - targets) / (n @ p)))
    assert np.allclose(sorted(plain), sorted(rates), atol=1e-6)


# Pipeline

def test_pipeline_equals_its_stages(spark, tmp_path, prose, documents):
    rnd = random.Random(13)
    rows, labels = [], []
    for i in range(120):
        text = "\n".join(prose("aa", 30) for _ in range(4)) + ("\nshared boilerplate line of the sites" if i % 2 else "")
        if i % 10 == 9:
            text = rows[-1][1].replace("ing", "ung", 1)
        if i % 11 == 10:
            text = text.replace(" ", " villain ", 6)
        rows.append((i, text, "aa", f"s{i % 15}"))
        labels.append((i, 1, int(i % 11 == 10)))
    rows += [(500 + i, t, None, None) for i, t in enumerate(ODD)]
    folder = str(tmp_path)
    documents(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]

    verdicts = plain_quality(now, linefreq.Limits())
    now = [r for r in now if verdicts[r[0], r[1] or ""][-1]]
    docs = corpus_pipeline.quality_rules(spark, docs, folder)
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r[0] for r in now)

    cut = {i: t for i, t in plain_spread(now, spread.Spread()) if words_of(t)}
    docs = corpus_pipeline.line_dedup(spark, docs, folder)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == cut
    assert sum("boilerplate" in t for t in cut.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    groups = plain_components(list(cut.items()), 5, 80)
    docs = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert {r["doc_id"] for r in docs.collect()} == {i for i, (_, c) in groups.items() if i == c}
    assert docs.count() < len(cut) and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before = docs.count()
    docs = corpus_pipeline.mixed(spark, docs, folder)
    left = {r["doc_id"] for r in docs.collect()}
    toxic = {i for i, _, x in labels if x}
    assert {i for i, (_, c) in groups.items() if i == c} - toxic <= left and len(left) < before
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(whole.columns) == Counter(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    assert {r["doc_id"] for r in whole.collect()} == left


def test_one_bucket_for_each_set_of_members(spark):
    held = {64: [1, 2, 3], 128: [3, 2, 1], 192: [1, 2], 65: [1, 2, 3], 129: [2, 3], 193: [2, 3], 256: [-5, 9]}
    rows = [(s, n) for s, nodes in held.items() for n in nodes]
    met = spark.createDataFrame(rows + rows[:4], "signature long, node long")  # a set given by two tasks
    got = {}
    for r in partenum.telling_buckets(met).collect():
        got.setdefault(r["signature"], []).append(r["node"])
    # Those of another band stay, as their profiles differ.
    assert {s: sorted(n) for s, n in got.items()} == {64: [1, 2, 3], 192: [1, 2], 65: [1, 2, 3], 129: [2, 3], 256: [-5, 9]}
    assert partenum.telling_buckets(met.limit(0)).count() == 0
