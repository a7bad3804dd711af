"""op9, op6, op8 and the joins they share, against brute force."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_data import MIDDLE
from pyspark.sql import functions as F

from tarnlake.llm import bagminhash, exact_dedup, fingerprint, skew

LAST = 1 << 62


def key(doc_id):
    return LAST if doc_id is None else doc_id


def rows_of(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text)


@pytest.mark.parametrize("support", [1 / 2000, 0.1])
def test_with_first_and_lookup_on_a_hot_key(spark, support):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), F.col("id").alias("place")).cache()
    want = defaultdict(list)
    for r in rows.collect():
        want[r["key"]].append(r["place"])
    got = skew.with_first(rows, "key", "place", support).collect()
    assert len(got) == 3000 and all((r["first"], r["size"]) == (min(want[r["key"]]), len(want[r["key"]])) for r in got)
    answers = rows.groupBy("key").agg(F.max("place").alias("top")).filter("key <> 'k5'")
    for most in (0, 1 << 20):
        got = skew.lookup(rows, "key", answers, support, most).collect()
        assert len(got) == 3000 and all(r["top"] == (None if r["key"] == "k5" else max(want[r["key"]])) for r in got)
    assert "hot" in {r["key"] for r in skew.frequent(rows, "key", support).collect()}


def test_exact_copies(odd):
    docs = rows_of(odd)
    groups = defaultdict(list)
    for d, t in docs:
        groups[normal(t)].append(d)
    got = exact_dedup.exact_copies(odd).collect()
    assert len(got) == len(docs)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_text[r["text_sha256"]]
        assert key(r["keep_id"]) == min(map(key, ids)) and r["group_size"] == len(ids) and r["doc_id"] in ids
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept) == set(by_text) and set(kept.values()) == {1}


def test_drop_copies_keeps_columns_and_one_row(odd, none):
    out = exact_dedup.drop_copies(odd)
    assert out.columns == odd.columns
    texts = [normal(t) for _, t in rows_of(out)]
    assert len(texts) == len(set(texts)) == len({normal(t) for _, t in rows_of(odd)})
    assert exact_dedup.drop_copies(none).count() == 0 and exact_dedup.exact_copies(none).count() == 0


def canonical(text):
    form = lambda x: unicodedata.normalize("NFKC", x)
    return " ".join(form(form(text).casefold()).split())


def order_of(text):
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


def going_down(frame):
    return sorted(rows_of(frame), key=lambda r: (r[0] is None, -(r[0] or 0), order_of(r[1])))


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_fingerprints(spark, odd, none, size):
    docs = going_down(odd)
    got = fingerprint.followed(odd, size).withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text"))).collect()
    want = []
    for k, (d, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        n = len(t) // 3
        want.append((d, t, following, t[: len(t) - n] + following[:n]))
    assert sorted(((r["doc_id"], r["text"], r["next_text"], r["edited"]) for r in got), key=repr) == sorted(want, key=repr)
    prints = {}
    for r in got:
        assert prints.setdefault(canonical(r["text"]), r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len(prints)
    assert fingerprint.followed(none).count() == 0
    one = odd.filter("doc_id = 3")
    assert [r["next_text"] for r in fingerprint.followed(one).collect()] == ["one"]


@pytest.mark.parametrize("size", [10, 100])
def test_frequent_and_missing_ids_are_divided(spark, size):
    hot = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id"))
    docs = spark.range(900).select(hot.cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 850).alias("text")).cache()
    down = going_down(docs)
    want = Counter((d, t, down[(k + 1) % len(down)][1]) for k, (d, t) in enumerate(down))
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in fingerprint.followed(docs, size).collect()) == want
    slim = docs.select("doc_id", fingerprint.turn(F.col("text")).alias("turn"))
    held = [r["count"] for r in fingerprint.Ranges(docs.select("doc_id"), size).of(slim).groupBy("at", "within").count().collect()]
    assert sum(held) == 900 and max(held) <= 3 * size + 20


@given(st.lists(st.integers(-50, 50), max_size=40), st.lists(st.integers(-60, 60), min_size=1, max_size=5))
@settings(max_examples=8, deadline=None)
def test_binary_search(spark, values, wanted):
    values = sorted(set(values))
    frame = spark.createDataFrame([(values, x) for x in wanted], "v array<long>, x long")
    got = frame.select("x", fingerprint.reached(F.col("v"), F.col("x"), max(1, len(values))).alias("n")).collect()
    assert all(r["n"] == sum(v < r["x"] for v in values) for r in got)


def written(frame, folder):
    frame.write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_colliding_texts_are_classes_of_their_own(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda text: F.when(F.length(text) > 3, F.lit("0" * 32)).otherwise(F.lit("1" * 32)))
    got = fingerprint.op6_fingerprints(spark, written(odd, tmp_path)).collect()
    forms = defaultdict(list)
    for d, t in rows_of(odd):
        forms[canonical(t)].append(d)
    prints = Counter(len(f) > 3 for f in forms)
    want = Counter((d, min((x for x in ids if x is not None), default=None), len(ids), prints[len(f) > 3]) for f, ids in forms.items() for d in ids)
    assert Counter((r["doc_id"], r["class_id"], r["class_size"], r["forms"]) for r in got) == want


def test_op6(spark, odd, tmp_path):
    got = fingerprint.op6_fingerprints(spark, written(odd, tmp_path)).collect()
    docs = going_down(odd)
    forms, want = defaultdict(list), Counter()
    for d, t in docs:
        forms[canonical(t)].append(d)
    for k, (d, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        n = len(t) // 3
        changed = t[: len(t) - n] + following[:n]
        same = forms[canonical(t)]
        near = [float(canonical(t) == canonical(x)) for x in (changed, following)]
        want[(d, len(t), hashlib.sha256(changed.encode()).hexdigest(), *near, min((x for x in same if x is not None), default=None), len(same), 1)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["class_id"], r["class_size"], r["forms"]) for r in got) == want


def test_op6_likeness(spark, tmp_path):
    frame = spark.createDataFrame([(1, "Straße  X"), (2, "STRASSE x"), (3, "ab")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.op6_fingerprints(spark, written(frame, tmp_path)).collect()}
    assert got[2]["near_next"] == 1.0 and got[1]["near_next"] == 0.0 and got[3]["near_edited"] == 1.0
    assert got[1]["class_id"] == got[2]["class_id"] == 1 and got[2]["class_size"] == 2 and got[3]["class_size"] == 1


def brute_classes(docs, near=0.8):
    sets = [Counter(bagminhash.occurrences(bagminhash.shingles(t)).tolist()) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both, either = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if not either or both >= near * either - 1e-9:
                root[find(a)] = find(b)
    out = defaultdict(list)
    for k in range(len(docs)):
        out[find(k)].append(docs[k][0])
    return Counter((key(d), min(map(key, ids)), len(ids)) for ids in out.values() for d in ids)


def test_no_near_pair_of_the_test_data_is_missed(spark):
    """All pairs of 10,000 documents whose similarity is 0.8 or more, by an index of all shingles, are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    place = {}
    node = [place.setdefault(bagminhash.occurrences(s).tobytes(), len(place)) for s in bagminhash.shingles_of([r["text"] or "" for r in docs])]
    sets = [np.frombuffer(x, "<u8") for x in place]
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    spread, pairs = Counter(), []
    for k, s in enumerate(sets):
        lo, hi = np.searchsorted(every, s), np.searchsorted(every, s, "right")
        both = Counter(v for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b - a > 1 for v in owner[a:b].tolist() if v > k)
        for v, n in both.items():
            near = n / (sizes[k] + sizes[v] - n)
            spread[int(10 * near + 1e-9)] += 1
            if near >= bagminhash.NEAR - 1e-12:
                pairs.append((k, v))
    of_doc = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()}
    class_of = {}
    for r, n in zip(docs, node, strict=True):
        assert class_of.setdefault(n, of_doc[r["doc_id"]]) == of_doc[r["doc_id"]]
    print("pairs of different texts by tenth of similarity", sorted(spread.items()), "near", len(pairs))
    assert len(pairs) > 20 and all(class_of[a] == class_of[b] for a, b in pairs)


def test_one_of_each_keeps_one_row_of_a_class(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (None, text + " x"), (None, text), (None, text + " y"), (3, text), (3, text), (4, "other words"), (None, "other words"), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, _id string")
    out = bagminhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], (r["text"] or "")[:5]) for r in out.collect()))) == ["(3, 'w0 w1')", "(4, 'other')", "(None, '')"]


@pytest.mark.parametrize("part", [4096, 7])
def test_a_large_group_is_compared_part_by_part(spark, part):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(80)] + [(100 + k, " ".join([*base[:40], *(f"x{k}" for _ in range(3))])) for k in range(5)]
    known = bagminhash.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [(1, len(rows), 0, k, bagminhash.occurrences(bagminhash.shingles(t)).astype("<u8").tobytes()) for k, (_, t) in enumerate(rows)]
    groups = spark.createDataFrame(sets, "key long, n long, first long, node long, payload binary")
    edges = bagminhash.links(groups, bagminhash.sets_near, True, tile=8, part=part)
    got = {r["node"]: r["root"] for r in bagminhash.components(edges).collect()}
    want = defaultdict(set)
    for d, c, _ in brute_classes(rows):
        want[c].add(d)
    found = defaultdict(set)
    for k, (d, _) in enumerate(rows):
        found[got.get(k, k)].add(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values())) and known.count() == len(rows)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components_of_a_hot_node(spark, monkeypatch, most):
    monkeypatch.setattr(bagminhash, "lookup", lambda *a: skew.lookup(*a, most=most))
    edges = [(0, k) for k in range(1, 700)] + [(k, k + 1000) for k in range(1, 50)] + [(5000, 5001), (5001, 5002), (5002, 5003)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r["node"]: r["root"] for r in bagminhash.components(frame).collect()}
    assert got == {n: 0 if n < 5000 else 5000 for e in edges for n in e}
    assert bagminhash.components(frame.filter("a < 0")).count() == 0


def test_sketches_of_many_are_those_of_each():
    texts = ["", "a b", "a b c d e", "a a a a a a a a a", " ".join("xyz"[k % 3] for k in range(400)), " ".join(map(str, range(900)))]
    sets = bagminhash.shingles_of(texts)
    assert [s.tolist() for s in sets] == [bagminhash.shingles(t).tolist() for t in texts]
    many = bagminhash.sketches_of(sets)
    for s, row in zip(sets, many, strict=True):
        assert row.tolist() == (bagminhash.sketch(s).tolist() if len(s) else [0] * bagminhash.REGISTERS)


@pytest.mark.parametrize("tile", [256, 4])
def test_near_duplicates(spark, odd, none, tile):
    got = bagminhash.classes(odd, tile).collect()
    assert Counter((key(r["doc_id"]), key(r["class_id"]), r["class_size"]) for r in got) == brute_classes(rows_of(odd))
    assert sum(r["kept"] for r in got) == len({r["class_id"] for r in got})
    assert bagminhash.classes(none, tile).count() == 0


def test_near_copies_of_one_text_in_many_degrees(spark):
    """A cluster that is connected only by way of some of its members, and larger than a tile."""
    random.seed(7)
    words = [f"w{random.randrange(10**6)}" for _ in range(150)]
    docs = []
    for k in range(60):
        own = list(words)
        for at in random.sample(range(150), k % 12):
            own[at] = f"x{random.randrange(10**6)}"
        docs.append((k, " ".join(own)))
    docs += [(100 + k, " ".join(f"y{random.randrange(10**6)}" for _ in range(80))) for k in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = bagminhash.classes(frame, 8).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == brute_classes(docs)
    kept = bagminhash.one_of_each(frame)
    assert kept.count() == len({c for _, c, _ in brute_classes(docs)}) and kept.columns == frame.columns


def test_sketches_are_unbiased_for_multisets():
    random_ = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        base = random_.integers(0, 2**63, 100).astype(np.uint64)
        a = random_.integers(0, 9, 100)
        b = np.where(random_.random(100) < 0.6, a, random_.integers(0, 9, 100))
        near = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        same = bagminhash.sketch(np.sort(np.repeat(base, a)), 512) == bagminhash.sketch(np.sort(np.repeat(base, b)), 512)
        errors.append(same.mean() - near)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in bagminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100, 300: 100}


def test_near_duplicates_of_the_test_data(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").filter("doc_id < 400")
    got = bagminhash.classes(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == brute_classes(rows_of(docs))
