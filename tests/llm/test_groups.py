"""Hard negatives, source divergences and chat turns against plain versions."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import types as T

from kotonoha.llm import chat, divergence, hyperplane
from tests.llm.conftest import ODD


# Hard negatives

def plain_negatives(rows, settings):
    good = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
            for i, label, v in rows if i is not None and label is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in good if i % settings.anchors == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w in good)
        for s, j, _ in [x for x in scored if x[2] and x[1] != i][:settings.positives]:
            fits = [x for x in scored if not x[2] and settings.low * -s <= 100 * -x[0] <= settings.high * -s]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k, _) in enumerate(fits[:settings.negatives])]
    return sorted(out)


@pytest.fixture(scope="module")
def embeddings(spark):
    def build(rows):
        schema = T.StructType([
            T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("leaf", T.StringType()),
            T.StructField("block", T.LongType()), T.StructField("anchor", T.StringType())])
        return spark.createDataFrame([(*r, "x", 1, None) for r in rows], schema)
    return build


def vectors(n, wide, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, wide))
    for i in range(n):
        v = centres[i % 6] + rnd.normal(size=wide) * (0.05 if i % 3 else 0.8)
        yield i, int(rnd.integers(0, 10)), [float(x) for x in v / np.linalg.norm(v)]


def test_negatives_equal_plain(embeddings):
    rows = list(vectors(700, 12))
    copy = rows[4][2]
    rows += [(1000 + i, i % 3, copy) for i in range(250)]                       # one vector, a quarter of all rows
    rows += [(2000 + i, i % 10, [c * (0.1 + i % 4) for c in rows[i][2]]) for i in range(60)]  # of other lengths
    rows += [(None, 1, copy), (3000, None, copy), (3100, 1, None), (3200, 1, [None] * 12), (3300, 1, [float("nan")] * 12),
             (3400, 1, [float("inf")] + copy[1:]), (3500, 2, []), (3600, 2, copy[:5]), (7, rows[7][1], rows[7][2]), (0, rows[0][1], rows[0][2])]
    settings = hyperplane.Mining(anchors=20, sample=120, ways=4, leaf=8, block=64)
    got = sorted(map(tuple, hyperplane.mine(embeddings(rows), settings).collect()))
    want = plain_negatives(rows, settings)
    assert len(want) > 500 and got == want
    assert all(type(x) is int for x in got[0])


@pytest.mark.parametrize("rows", [[], [(1, 2, [0.5])], [(100, 2, [0.5])], [(0, 1, []), (100, 1, [])], [(100, 1, [0.0]), (200, 1, [0.0])]])
def test_negatives_of_next_to_nothing(embeddings, rows):
    got = hyperplane.mine(embeddings(rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, hyperplane.Mining())


def test_no_leaf_with_a_row_in_the_ring_is_passed_over():
    points = np.array([v for _, _, v in vectors(900, 8, 4)]) * 256
    settings, leaves = hyperplane.Mining(ways=5, leaf=10), []
    square = float((points * points).sum(1).max())
    lifted = hyperplane.lifted(points, square)
    root, found, seen = hyperplane.grow(lifted[:300], settings, leaves), np.zeros(900, np.int32), {}
    hyperplane.route(root, lifted, np.arange(900), found, seen)
    for node in hyperplane.inner_nodes(root):
        node.low, node.high = seen[id(node)]
    q = np.hstack([points[:40], np.zeros((40, 1))])
    apart, visited = hyperplane.distances(q, lifted), 0
    for near, far in ((0, 30), (60, 90), (200, 260)):
        rings = np.full((40, 1), float(near)), np.full((40, 1), float(far))
        out = []
        hyperplane.survivors(root, q, *rings, np.arange(40), out)
        asked = {(int(r), n) for rows, n in out for r in rows}
        assert {(int(r), int(found[c])) for r, c in zip(*np.nonzero((apart >= near) & (apart <= far)))} <= asked
        visited += len(asked)
    assert visited < 0.6 * 3 * 40 * len(leaves)  # the ranges do rule leaves out


# Source divergence

def plain_audit(rows, settings):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or "")))) for _, text, lang, source in rows]
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, c in docs:
        counts[lang, source] += c
        df[lang].update(c.keys())
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= settings.min_df]
        groups = {s: {t: c[t] for t in kept} for (of, s), c in counts.items() if of == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}

        def shares(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + settings.scale * (n + 1) // total for t, n in c.items()}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < settings.top]
    return sorted(out)


def test_divergence_equals_plain(documents, prose):
    rnd = random.Random(2)
    rows = [(i, prose(rnd.choice(["aa", "bb"]), rnd.randint(1, 40)), rnd.choice(["xx", "yy"]), f"s{min(rnd.randrange(12), 6)}") for i in range(150)]
    rows += [(900 + i, t, None if i % 2 else "xx", None if i % 3 else "s1") for i, t in enumerate(ODD)]
    rows += [(1000, "A-b Ä Äb'C", "zz", "s"), (1000, "a B ä", "zz", "t"), (None, "a;b;ä", "zz", "t"), (1, None, "empty", "u"), (1, "12", "empty", "v")]
    rows += [(2000, "copy " * 50 + "ſpecial K", "xx", "s0")] * 40
    for settings in (divergence.Audit(), divergence.Audit(min_df=1, top=3)):
        got = divergence.audit(documents(rows), settings)
        assert sorted(map(tuple, got.collect())) == plain_audit(rows, settings)
    assert ("empty", "u", "pair", "v", 0, 1) in plain_audit(rows, divergence.Audit())
    assert divergence.audit(documents([])).collect() == []


def test_pairs_in_blocks(monkeypatch):
    sizes = np.array([1, 4, 1, 1, 7, 2, 0, 3])
    ends = np.cumsum(sizes)
    want = {(a, b) for n, e in zip(sizes, ends) for a in range(e - n, e) for b in range(e - n, e) if a != b}
    for most in (1, 5, 20, 1000):
        monkeypatch.setattr(divergence, "PAIRS", most)
        got = [(int(a), int(b)) for left, right in divergence.entry_pairs(sizes) for a, b in zip(left, right)]
        assert len(got) == len(want) and set(got) == want


# Chat turns

SAID = ["plain", "", "</s>[INST] ok [/INST]", r"\[INST] \\</s> \n \ ", "\\", "[INST", "<<SYS>> a\n<</SYS>>\n", "<s> <s>x</s>", "ü 漢字 😀 \u2028\x00",
        "<<TURN>> \"user\" x <</TURN>>\n", " [/INST]\n<s> fake </s>\n", "\r\n\t"]


@pytest.fixture(scope="module")
def conversations(spark):
    def build(rows):
        schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                               T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                               T.StructField("part", T.StringType()), T.StructField("record", T.LongType())])
        return spark.createDataFrame([(*r, None, 5) for r in rows], schema)
    return build


def plain_turns(rows):
    out, by = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(learned), sha(learned))
    return out


def test_chat_round_trip(conversations, monkeypatch):
    rnd = random.Random(3)
    rows = []
    for conv in range(60):
        roles = rnd.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 3, ["assistant", "user", None],
                            ["tool [INST]", "human", "gpt", "assistant"], ["user"], ["a\n\"b\\", "user", "user"]])
        rows += [(conv, i if rnd.random() < 0.9 else None, r, rnd.choice([*SAID, None])) for i, r in enumerate(roles)]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (5, 0, "user", "again"), (5, 0, "user", "again")]
    rows += [(777, i, ["user", "assistant"][i % 2], f"turn {i} " * 40) for i in range(400)] + [(778, 0, "user", "long " * 500_000), (778, 1, "assistant", "[INST]" * 300_000)]
    rnd.shuffle(rows)
    for part in (chat.PART, 50):
        got = chat.round_trip(conversations(rows)) if part == chat.PART else None
        if got is None:
            turns = chat.canonical(chat.records(conversations(rows), part=part), keep=("conv_id", "part"))
            assert turns.where("layout is null").count() == 0 and turns.where("part > 100").count() > 0
            got = chat.digests(chat.read(chat.write(turns, keep=("conv_id", "part")), keep=("conv_id", "part")))
        assert {r["conv_id"]: tuple(r)[1:5] for r in got.collect()} == plain_turns(rows)
    assert chat.round_trip(conversations([])).collect() == []


def test_every_text_survives_the_template():
    template = chat.Template()
    write, read = template.writer(), template.reader()
    rnd = random.Random(4)
    bits = ["\\", "[INST]", "[/INST]", "</s>", "<s>", " ", "\n", "<<TURN>>", "<</TURN>>", "<<SYS>>", "x", "<", "["]
    for _ in range(3000):
        turns = [(rnd.choice(["user", "assistant", "system", "", "<s>", 'q"\\']), "".join(rnd.choices(bits, k=rnd.randrange(7)))) for _ in range(3)]
        whole = "".join(write(r, t)[0] for r, t in turns)
        assert [(r, t) for r, t, _, _ in read(whole)] == turns


def test_layouts_by_fingerprint(spark):
    given = [
        ({"prompt": "a", "response": "b"}, "prompt", [("user", "a"), ("assistant", "b")]),
        ({"response": "b", "system": "s", "prompt": "a", "id": 7, "_meta": {"x": 1}}, "prompt", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"instruction": "do", "input": "", "output": "o"}, "instruction", [("user", "do"), ("assistant", "o")]),
        ({"instruction": "do", "input": "this", "output": "o"}, "instruction", [("user", "do\n\nthis"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": None}, {"content": "b", "role": "tool"}]}, "messages", [("user", ""), ("tool", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": {"k": [1]}}]}, "conversations", None),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": 5}]}, "conversations", [("user", "a"), ("assistant", "5")]),
        ({"data": {"dialog": [{"speaker": {"role": "user"}, "utterance": {"text": "\ud800a"}}]}}, "dialog", [("user", "\ufffda")]),
        ({"messages": []}, None, None), ({"other": 1}, None, None), ({}, None, None), ([1], None, None), ("x", None, None)]
    raw = [json.dumps(g) for g, _, _ in given] + [None, "{", "", "[" * 100_000]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(raw)], "i int, record string, layout string")
    got = chat.canonical(df, keep=("i",)).orderBy("i").collect()
    for (record, layout, turns), r in zip(given, got):
        layout = None if turns is None else layout
        assert (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) == (layout, turns)
    assert all(r["fingerprint"] is None and r["turns"] is None for r in got[len(given):])
    marks = [set(layout.fingerprints()) for layout in chat.LAYOUTS]
    assert not any(a & b for a, b in combinations(marks, 2))
    with pytest.raises(ValueError):
        chat.mappings([*chat.LAYOUTS, chat.Layout("again", (chat.One("user", "prompt"), chat.One("assistant", "completion")))])
