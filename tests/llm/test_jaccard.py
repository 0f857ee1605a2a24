import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caremart.llm import jaccard

SF = "/root/testdata/sf0.001"


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = min(size, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= max(len(a), len(b)) * percent:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def joined(docs, **settings_):
    return sorted((tuple(r) for r in jaccard.link_components(docs, **settings_).collect()), key=repr)


def near_copies(rnd, copies, words, edits):
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        w = base[:]
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(40)}"
        out.append(" ".join(w))
    return out


def test_shingles_are_distinct_and_lower_cased():
    texts = ["A b C d", "a B c D  ", "É b c d", "one two", "", None, "x x x x x"]
    got = [len(s) for s in jaccard.shingle_sets(texts)]
    assert got == [len(shingles(t)) for t in texts]
    a, b, c = list(jaccard.shingle_sets(texts[:3]))
    assert a.tolist() == b.tolist() != c.tolist()


def test_documents_against_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert joined(documents) == brute(rows)


@pytest.mark.parametrize("percent", [90, 80])
def test_near_copies_chains_and_frequent_lines(spark, percent):
    rnd = random.Random(percent)
    line = "this line stands in very many of the documents as a frequent one"
    texts = near_copies(rnd, 60, 70, 3) + near_copies(rnd, 40, 12, 2) + near_copies(rnd, 30, 150, 9)
    texts += [f"{line} {' '.join(f'r{rnd.randrange(10 ** 6)}' for _ in range(rnd.randrange(6)))}" for _ in range(60)]
    chain = [f"c{i}" for i in range(60)]
    for k in range(12):  # each linked to the next, the ends not to each other
        chain = chain[1:] + [f"d{k}"]
        texts.append(" ".join(chain))
    texts += [texts[0]] * 5 + ["tiny text"] * 4 + ["TINY Text", "tiny texts", "a", "", None]
    rnd.shuffle(texts)
    rows = list(enumerate(texts, 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(docs, percent=percent) == brute(rows, percent)


def test_odd_and_empty(odd_documents, empty_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert joined(odd_documents) == brute(rows)
    assert joined(empty_documents) == []


def test_one_document_of_each_component_stays(odd_documents, spark):
    rows = [(3, "a b c d", "x"), (2, "A b c d", "y"), (2, "A b c d", "y"), (2, "quite another text", "z"), (9, None, "n"),
            (None, "a b c d", "q"), (None, "no id at all", "q")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(2, "A b c d", "y"), (2, "quite another text", "z"),
                                                        (9, None, "n"), (None, "no id at all", "q")], key=repr)
    assert jaccard.keep_one(odd_documents).count() == 10  # of 11 rows one is repeated


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.sampled_from([80, 90]))
def test_prefixes_of_linked_sets_meet_under_any_order(x, y, percent):
    both = len(x & y)
    if 100 * both < percent * (len(x) + len(y) - both):
        return
    for seed in (1, 2, 3):
        order = list(range(61))
        random.Random(seed).shuffle(order)
        first = lambda s: set(sorted(s, key=order.index)[:len(s) - -(-len(s) * percent // 100) + 1])
        assert first(x) & first(y)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101 + i) for i in range(30)] + [(7, 3)]
    got = {r["id"]: r["comp"] for r in jaccard.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 131)}


def test_a_full_bucket_fits_beside_others_in_an_executor():
    rng = np.random.default_rng(3)
    tokens = np.sort(rng.integers(0, 1 << 47, jaccard.BUCKET_TOKENS // 2, np.uint64))
    runs = np.full(500, len(tokens) // 500, np.uint32)
    tokens = tokens[:int(runs.sum())]
    row = lambda k: (3, np.arange(500).tobytes(), np.full(500, k).tobytes(), runs.tobytes(),
                     jaccard._six(tokens).tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(row(0), row(1))],
                                       names=["bucket", "ka", "kb", "runs", "tokens"])
    tracemalloc.start()
    out = list(jaccard._shared_tokens(64)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 1000 and peak < 200e6


def test_the_parts_of_a_bucket_find_what_its_classes_share():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 400, 60)).astype(np.uint64) for _ in range(12)]
    at = 5
    for bucket in (at, 64 + at):  # a bucket, and one of frequent shingles, where all count as shared
        raw = (lambda s: s.tobytes()) if bucket >= 64 else (lambda s: jaccard._six(s).tobytes())
        named = [s | np.uint64(at << 48) for s in sets]
        rows = [(bucket, np.int64(k).tobytes(), np.int64(-k).tobytes(), np.uint32(len(s)).tobytes(), raw(s))
                for k, s in enumerate(named)]
        rows += rows[:3]  # a class that comes from two tasks
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a:b])],
                                              names=["bucket", "ka", "kb", "runs", "tokens"]) for a, b in ((0, 7), (7, 15))]
        got = {r["ka"]: sorted(r["tokens"]) for out in jaccard._shared_tokens(64)(iter(batches)) for r in out.to_pylist()}
        count = Counter(t for s in named for t in s.tolist())
        least = 1 if bucket >= 64 else 2
        want = {k: sorted(t for t in s.tolist() if count[t] >= least) for k, s in enumerate(named)}
        assert got == {k: v for k, v in want.items() if v}


def test_a_full_bucket_takes_little_beside_its_rows():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 1 << 47, jaccard.BUCKET_TOKENS, np.uint64)
    each = 2000
    rows = [(3, np.arange(at, at + each // 8).tobytes(), np.zeros(each // 8, np.int64).tobytes(),
             np.full(each // 8, 8, np.uint32).tobytes(), jaccard._six(tokens[at:at + each]).tobytes())
            for at in range(0, len(tokens), each)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["bucket", "ka", "kb", "runs", "tokens"])
    del rows, tokens
    tracemalloc.start()
    list(jaccard._shared_tokens(64)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6
