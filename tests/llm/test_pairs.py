"""Problems 1, 2 and 4 against brute force on small fixtures with nulls, copies, ties, long texts and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import p1_overlap, p2_near, p4_canonical
from lexloom.llm.base import distinct_sorted, grams, shared_counts

SCHEMA = "sample_id bigint, task_id bigint, text string, label string, language string, source string, split string, n string, id string, h string, rep string"


def normal(t):
    import regex

    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", t.lower()).strip()


def windows(t):
    return {t[i : i + 5] for i in range(len(t) - 4)}


def similarity(a, b):
    x, y = windows(a), windows(b)
    return len(x & y) / len(x | y)


def fixture(seed=1, n=120):
    r = random.Random(seed)
    syll = "ka lo mi ren sta vor ul 米 更 换 ça ño की".split()
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(2, 4)))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(r.randint(6, 40))]
        rows.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            b = list(base)
            for _ in range(r.randint(0, 5)):
                k = r.randrange(len(b))
                r.choice([lambda: b.insert(k, word()), lambda: b.__setitem__(k, word()), lambda: b.append(b.pop(k))])()
            rows.append((", " if r.random() < 0.5 else "  ").join(b).upper() if r.random() < 0.2 else " ".join(b))
    rows += ["", None, "short", "   ", "x" * 30_000, "x" * 30_001, rows[0], rows[0] + "!", "…" * 50]
    splits = ["train", "train", "train", "val", "validation", "test", None, "Other"]
    return [(i, r.choice([1, 1, 1, 2, None]), t, None, None, "s", r.choice(splits), "c", "c", "c", "c") for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def table(spark):
    rows = fixture()
    return rows, spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(5)


def eligible(rows):
    return [(r[0], r[1], normal(r[2]), r[6]) for r in rows if r[2] is not None and len(normal(r[2])) >= 20]


def test_overlaps_equal_brute_force(table):
    rows, df = table
    e = eligible(rows)
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in e for b in e if a[1] is not None and a[1] == b[1] and a[3] == "train" and b[3] in ("val", "validation", "test") and similarity(a[2], b[2]) >= 0.7 - 1e-9}
    got = [tuple(r) for r in p1_overlap.found(df).collect()]
    assert set(got) == want and len(got) == len(want) > 10


def test_overlaps_in_many_parts(table, monkeypatch):
    rows, df = table
    whole = {tuple(r) for r in p1_overlap.found(df).collect()}
    monkeypatch.setattr(p1_overlap, "SHARD", 3000)
    monkeypatch.setattr(p1_overlap, "BLOCK", 5000)
    assert {tuple(r) for r in p1_overlap.found(df).collect()} == whole


def test_train_texts_go_only_where_a_partner_may_be(spark):
    """Texts of one small vocabulary share most windows with every shard, but few of them have a partner."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(200)]
    text = lambda: " ".join(r.choice(words) for _ in range(40))
    rows = [(i, 1, 1, text(), i % 8) for i in range(400)]
    rows += [(1000 + i, 1, 0, text(), None) for i in range(300)] + [(2000 + i, 1, 0, rows[i][3][:-3], None) for i in range(40)] + [(3000, 1, 0, rows[7][3], None), (3001, 1, 0, rows[7][3], None)]
    d = spark.createDataFrame([(*x, 3, 2) for x in rows], "id bigint, task bigint, ev int, n string, shard int, wide int, lots int").repartition(4)
    got = {tuple(x) for x in p1_overlap._routed(d, p1_overlap.SIMILARITY).select("id", "shard").collect()}
    want = {(2000 + i, i % 8) for i in range(40)} | {(3000, 7), (3001, 7)}
    assert want <= got and len(got) < len(want) + 20


def test_parities_lose_no_pair():
    r = random.Random(6)
    base = [" ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(r.choice([4, 40, 45, 90, 180, 700]))) for _ in range(60)]
    change = lambda t: "".join(r.choice("abcdef") if r.random() < 0.03 else c for c in t)
    train, evaluation = base, [change(t)[: int(len(t) * r.uniform(0.72, 1))] for t in base] + [t + t[:50][::-1] for t in base]
    (th, tb), (eh, eb) = distinct_sorted(*grams(train)), distinct_sorted(*grams(evaluation))
    pair = lambda bits: set(zip(*(x.tolist() for x in p1_overlap._alike(p1_overlap._parities(th, tb, bits), np.diff(tb), p1_overlap._parities(eh, eb, bits), np.diff(eb), 0.7))))
    want = {(i, j) for i, a in enumerate(train) for j, b in enumerate(evaluation) if similarity(a, b) >= 0.7 - 1e-9}
    assert len(want) > 60
    for bits in (128, 512, 8192):
        assert want <= pair(bits)


def test_matches_are_maximal_to_both_sides():
    r = random.Random(7)
    evaluation = ["abcdefgh", "defghij", "".join(r.choice("ab") for _ in range(900)), *("".join(r.choice("abc") for _ in range(60)) for _ in range(20))]
    index = p1_overlap.RunIndex(evaluation)
    assert index.matches(["abcdefghij"])[1][0] == 8  # defghij alone would be the longest from the right
    texts = [evaluation[2][100:880], "abcdefghij"] + ["".join(r.choice("abc") for _ in range(r.choice([5, 30, 80]))) for _ in range(30)]
    occurs = lambda x: any(x in e for e in evaluation)
    for text in texts:
        want = set()
        right = 0
        for p in range(len(text) - 4):
            e = max(p, right)
            while e < len(text) and occurs(text[p : e + 1]):
                e += 1
            if e > right and e - p >= 5:
                want.add((p, e))
            right = max(right, e)
        covered = {i for p, e in want for i in range(p, e)}
        c, longest = index.matches([text])
        assert (c[0], longest[0]) == (len(covered), max((e - p for p, e in want), default=0))
        s = index.symbols(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        at = [p for p in range(len(text) - 4) if occurs(text[p : p + 5])]
        begin = [p for p in at if p - 1 not in at]
        end = [p + 5 for p in at if p + 1 not in at]
        _, x, y = index.maximal(s, np.array(begin, np.int64), np.array(end, np.int64))
        assert sorted(zip(x.tolist(), y.tolist())) == sorted(want)


@pytest.mark.parametrize("letters", ["ab", "abcdefghij", "".join(map(chr, range(0x4E00, 0x4E00 + 6000)))])
def test_maximal_matches_take_few_rounds(letters, monkeypatch):
    r = random.Random(8)
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    text, run = make(3000), letters[0] * 700
    evaluation = [text[:1500] + letters[-1] * 2 + text[1500:], text[900:2000], text[100:1200] + letters[0] * 3, run, run[:50] + make(3) + run[:300], run[:299], make(6000) if len(letters) > 10 else make(200)]
    index = p1_overlap.RunIndex(evaluation)
    rounds = []
    for name in ("step", "narrowed"):
        f = getattr(p1_overlap.RunIndex, name)
        monkeypatch.setattr(p1_overlap.RunIndex, name, lambda *x, f=f: rounds.append(1) or f(*x))
    texts = [text, run + letters[1] * 9, run[:298], text[800:1000] + run[:20] + text[1400:1700]]
    covered, longest = index.matches(texts)
    assert 0 < len(rounds) < 1000  # one for each character and side would be more than 3,000
    for k, t in enumerate(texts):
        right, want = 0, []
        for p in range(len(t) - 4):
            e = max(p, right)
            while e < len(t) and any(t[p : e + 1] in x for x in evaluation):
                e += 1
            if e > right and e - p >= 5:
                want.append((p, e))
            right = max(right, e)
        assert (covered[k], longest[k]) == (len({i for p, e in want for i in range(p, e)}), max(e - p for p, e in want))


def test_index_counts_windows():
    index = p1_overlap.RunIndex(["banana bandana", "anana"])
    s = lambda w: np.array([[np.searchsorted(index.alphabet, ord(c)) + 1 for c in w]])
    for w, n in (("anana", 2), ("banan", 1), ("ndana", 1), ("nanab", 0)):
        lo, hi = index.search(s(w))
        assert hi[0] - lo[0] == n


def test_large_alphabets():
    r = random.Random(2)
    texts = ["".join(chr(0x4E00 + r.randrange(12_000)) for _ in range(60)) for _ in range(300)]
    i, j, s, *_ = p1_overlap.pairs(texts[:200], [t[:58] + "xy" for t in texts[:50]] + texts[250:])
    assert set(zip(i.tolist(), j.tolist())) == {(k, k) for k in range(50)}


def test_repeated_foreign_windows_count_once():
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh") for _ in range(104))
    train = [text + "z" * 60, text + "zyzyx" * 12, text[:90] + "z" * 60]
    i, j, s, *_ = p1_overlap.pairs(train, [text])
    want = {k: similarity(t, text) for k, t in enumerate(train) if similarity(t, text) >= p1_overlap.SIMILARITY}
    assert set(want) == {0, 1, 2} and dict(zip(i.tolist(), s.tolist())) == pytest.approx(want) and set(j.tolist()) == {0}


def test_near_pairs_equal_brute_force(table):
    rows, df = table
    e = eligible(rows)
    want = {(a[0], b[0]) for a in e for b in e if a[0] < b[0] and (a[2] == b[2] or similarity(a[2], b[2]) >= 0.8 - 1e-9)}
    got = {tuple(r) for r in p2_near.found(df).collect()}
    assert not got - want
    assert len(want - got) <= 0.01 * len(want) and len(want) > 50


def test_hot_keys_are_split(table, monkeypatch):
    _, df = table
    whole = {tuple(r) for r in p2_near.found(df).collect()}
    r = np.random.default_rng(5)
    key, ids, size = r.integers(0, 3, 60).astype(np.uint32), np.arange(60) * 7, r.integers(50, 90, 60).astype(np.uint16)
    monkeypatch.setattr(p2_near, "HOT", 1)
    monkeypatch.setattr(p2_near, "LOT", 4)
    hot, lots = p2_near._hot(1, key, ids, size, 1, 4)
    assert hot.all() and sum(len(x[4]) // 10 for x in lots) == 60 and max(len(x[4]) // 10 for x in lots) == 4
    split = df.sparkSession.createDataFrame([(a, b, lo, hi, bytearray(x)) for a, b, lo, hi, x in lots], p2_near._MET)
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(60) for j in range(i) if key[i] == key[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) - 1e-9}
    got = [tuple(x) for x in p2_near._split(split).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {tuple(x) for x in p2_near.found(df).collect()} == whole


def test_all_pairs_within_the_signature_distance_meet():
    r = np.random.default_rng(3)
    a = r.integers(0, 256, (400, p2_near.K)).astype(np.uint8)
    b = a.copy()
    for row in b:
        at = r.choice(p2_near.K, p2_near.PARTS * (p2_near.ERRORS + 1) - 1, replace=False)
        row[at] ^= 0x55
    assert ((p2_near.entries(a) == p2_near.entries(b)).any(1)).all()


def test_groups_hold_every_record_once(table):
    rows, df = table
    g = p2_near.groups(df.dropDuplicates(["sample_id"])).toPandas()
    assert sorted(g.sample_id) == sorted(x[0] for x in eligible(rows))
    pairs = [tuple(r) for r in p2_near.found(df).collect()]
    of = dict(zip(g.sample_id, g.grp))
    assert all(of[a] == of[b] for a, b in pairs)


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert p1_overlap.found(e).count() == p2_near.found(e).count() == p4_canonical.found(e).count() == 0
    assert p2_near.groups(e).count() == p4_canonical.collapsed(e).count() == 0


def test_set_helpers():
    h, b = distinct_sorted(*grams(["abcdefabcdef", "bcdefg", "", "abc"]))
    assert np.diff(b).tolist() == [6, 2, 0, 0]
    assert shared_counts(h, b, np.array([0, 0, 2]), np.array([1, 2, 3])).tolist() == [1, 0, 0]


def test_canonical_duplicates(spark):
    rows = [
        'Hello, World', "hello​   WORLD!", '{"a": "x y", "b": 4}', "B: 4 | A: X, y", "b: 4\na: xy", '{"b": 4.0, "a": "x y"}', "a: xy", '[1, 2]', "", None, "!!!", "…", "a: 1\nno field", "A 1 no field",
        '{"a": "x", "a": "x"}', '{"a":"x"}', "Straße", "STRASSE",
    ]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(rows)] + [(0, rows[0], "x", "x")], "sample_id bigint, text string, h string, c string")
    got = {tuple(r) for r in p4_canonical.found(df).collect()}
    assert got == {(0, 1), (2, 3), (2, 4), (12, 13), (14, 15)}
    c = {r.sample_id: r.copies for r in p4_canonical.collapsed(df.dropDuplicates(["sample_id"])).collect()}
    assert c[2] == 3 and sum(c.values()) == len([t for t in rows if t and any(ch.isalnum() for ch in t)])


def test_records_with_outer_dividers_are_records(spark):
    rows = ["| name: Ann | city: Oslo |", "city: Oslo | name: Ann", " || city: OSLO\n| name: Ann", "| name: Ann", "| city Oslo name Ann"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "sample_id bigint, text string")
    assert {tuple(r) for r in p4_canonical.found(df).collect()} == {(0, 1), (0, 2)}


def test_hot_sets_are_salted(spark, monkeypatch):
    df = spark.range(6000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 > 0, F.lit("Same text")).otherwise(F.concat(F.lit("other "), F.col("id"))).alias("text"))
    got = p4_canonical.found(df)
    assert got.count() == 3999 and got.where("sample_id_a <> 1").count() == 0


def test_collisions_do_not_merge(spark):
    keys = spark.createDataFrame([(1, bytearray(b"h"), 5, 3), (2, bytearray(b"h"), 6, 3), (3, bytearray(b"h"), 5, 3)], "id bigint, h binary, chk bigint, len int")
    assert [(r.first, r.id) for r in p4_canonical.surplus(keys).collect()] == [(1, 3)]


def test_nulls_in_any_column(spark):
    text = "the same text in every one of these rows"
    rows = [(i, 1, text, None, None, None, s, None, None, None, None) for i, s in enumerate(["train", "test", None, "val"])]
    rows += [(None, 1, text, None, None, None, "train", None, None, None, None), (9, None, text, None, None, None, "test", None, None, None, None), (None,) * 11]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in p1_overlap.found(df).collect()} == {(0, 1), (0, 3)}
    assert p2_near.found(df).count() == 10
    assert {tuple(r) for r in p4_canonical.found(df).collect()} == {(0, i) for i in (1, 2, 3, 9)}
