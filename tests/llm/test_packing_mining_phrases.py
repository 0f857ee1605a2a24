"""Operators 11 to 13 against the tokenizers library, exhaustive search and plain counting."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caremart.llm import collocations, negatives, packing


def library_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [[*e.ids, packing.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(rows, docs, size):
    """Every id of every document lies in one piece, sequences are gapless and all but the last are full."""
    want = sorted(((d, tuple(i)) for (d, _), i in zip(docs, library_ids([t for _, t in docs]))), key=repr)
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    end, seen, held = 0, [], []
    for r in stream:
        assert r["sequence_id"] * size + r["offset"] == end and 0 < r["length"] <= size - r["offset"]
        end += r["length"]
        assert r["start"] == len(held)
        assert r["comes_from"] == (r["start"] > 0)
        held += r["ids"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert r["goes_on"] == (r["start"] + r["length"] < r["doc_tokens"])
        if not r["goes_on"]:
            assert len(held) == r["doc_tokens"]
            seen.append((r["doc_id"], tuple(held)))
            held = []
    assert not held and sorted(seen, key=repr) == want
    assert end == sum(len(i) for _, i in want)


@pytest.mark.parametrize("size,parts", [(2048, 1), (64, 3), (7, 8)])
def test_packing_against_the_library(spark, documents, size, parts):
    docs = documents.select("doc_id", "text").repartition(parts)
    rows = packing.pack(docs, size=size, with_ids=True).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], size)


def test_packing_odd_and_empty(spark, odd_documents, empty_documents):
    extra = [(20, "special <|endoftext|> and<|startoftext|>inside <|endoftext|>"), (21, "a\x1cb\x85c d　e é ́x"),
             (22, "İstanbul ΣΑΣ it's 1234 ﬁ \U0001f600\U0001f600"), (23, "line\n\nline\r\n tab\tend"), (24, " "), (24, " ")]
    docs = odd_documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = packing.pack(docs.withColumn("ids", F.lit("mine")).withColumn("part", F.lit(None)), size=1000, with_ids=True).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 1000)
    assert packing.pack(empty_documents).collect() == []


def test_packed_sequences_hold_all_ids(spark, documents):
    cut = packing.pack(documents, size=512, with_ids=True)
    rows = packing.sequences(cut, 512).orderBy("sequence_id").collect()
    assert all(len(r["ids"]) == 512 for r in rows) and all(r["n_ids"] == 512 for r in rows[:-1])
    ids = [i for r in rows for i in r["ids"][:r["n_ids"]]]
    assert len(ids) == sum(map(len, library_ids([r["text"] for r in documents.collect()])))
    pieces = {(r["sequence_id"], r["offset"]): (r["doc_id"], r["start"], r["length"]) for r in cut.collect()}
    assert pieces == {(r["sequence_id"], b["offset"]): (b["doc_id"], b["start"], b["length"])
                      for r in rows for b in r["bounds"]}


def mined(rows, is_anchor, k=5):
    """Exhaustive search over (id, label, vector of whole numbers); equal rows once."""
    rows = sorted({(i, g, tuple(x)) for i, g, x in rows})
    out = set()
    for i, g, q in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j, h) for j, h, x in rows if j != i)
        for s, p, _ in [r for r in scored if r[2] == g][:k]:
            near = [(t, j) for t, j, h in scored if h != g and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out |= {(i, p, n + 1, j, -s, -t) for n, (t, j) in enumerate(near)}
    return out


def as_rows(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
                  for r in df.collect())


@pytest.mark.parametrize("shard,kind", [(40, "random"), (1000, "clusters"), (64, "ties")])
def test_hard_negatives_against_exhaustive_search(spark, shard, kind):
    rng = np.random.default_rng(5)
    n = 400
    if kind == "random":
        x = rng.normal(size=(n, 12)) * 0.3
    elif kind == "clusters":
        x = rng.normal(size=(10, 6))[rng.integers(0, 10, n)] + rng.normal(size=(n, 6)) * 0.05
    else:
        x = rng.integers(-1, 2, size=(n, 3)) / 4  # copies by the dozen, ties everywhere
    labels = rng.integers(0, 3, n)
    data = [(i, [float(v) for v in r], int(g)) for i, (r, g) in enumerate(zip(x, labels))]
    rows = negatives.valid_rows(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    got = as_rows(negatives.mine(rows, F.col("vec_id") % 10 == 0, shard=shard))
    want = mined([(i, g, np.floor(256 * np.array(v)).astype(int).tolist()) for i, v, g in data], lambda i: i % 10 == 0)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(1)
    x = np.floor(64 * (8 * rng.normal(size=(40, 4))[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 4))))
    x = np.unique(x, axis=0)
    tree = negatives.CoverTree.unpacked(negatives.CoverTree(x, np.zeros(len(x)), [(i,) for i in range(len(x))], leaf=8).packed())
    squares = (tree.points ** 2).sum(axis=1)
    up = np.column_stack([tree.points, np.sqrt(tree.top - squares)])
    for k in range(len(tree.count)):
        c = tree.centres[k]
        gap = up[tree.low[k]:tree.high[k]] - np.append(c, math.sqrt(max(0.0, tree.top - c @ c)))
        assert np.sqrt((gap ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-6
        if tree.count[k]:
            kids = range(tree.first[k], tree.first[k] + tree.count[k])
            assert sum(tree.high[i] - tree.low[i] for i in kids) == tree.high[k] - tree.low[k]
    read = []
    exact = tree._exact
    tree._exact = lambda rows, q, size: read.append(len(rows)) or exact(rows, q, size)
    q = x[17]
    got = tree.search(q, 0, True, [(-math.inf, math.inf)], 5)[0]
    assert got == sorted((-int(s), i) for i, s in enumerate(x @ q))[:5]
    assert sum(read) < len(x) / 4  # most leaves are never read


def test_hard_negatives_odd_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    hot = [(i, [0.5, 0.25], 1) for i in range(100, 400, 1)]  # one vector that most rows hold
    data = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (0, [0.25, 0.5], 1), (1, [0.5, 0.25], 2), (2, [0.5, 0.25], 2),
            (3, None, 1), (4, [0.5, None], 1), (5, [nan, 0.0], 1), (6, [inf, 0.0], 2), (7, [0.5], None), (8, [], 2),
            (9, [0.5], 2), (None, [0.5, 0.5], 2), (10, [0.0, 0.0], 1), (-10, [-0.5, -0.5], 2), (20, [4e6, 4e6], 3),
            (30, [3e6, 4e6], 3), (40, [4e6, 3.5e6], 4), (50, [1.0, 0.25, 2.0], 2), *hot]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<double>, label int, x int")
    got = as_rows(negatives.mine(negatives.valid_rows(df), F.col("vec_id") % 10 == 0, shard=50))
    ok = [(i, g, [math.floor(256 * v) for v in (*x, 0, 0, 0)[:3]]) for i, x, g in data
          if None not in (i, x, g) and all(v is not None and math.isfinite(v) for v in x)]
    want = mined(ok, lambda i: i % 10 == 0)
    assert set(got) == want and want
    empty = negatives.mine(negatives.valid_rows(df.filter("false")), F.col("vec_id") % 10 == 0)
    assert empty.collect() == []


def phrases(rows, least, top):
    """Plain counting of every phrase."""
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        for p, a in cand.items():
            if longer[p] >= a:
                continue
            s, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                    for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s)
                for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def found_phrases(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("least,top", [(100, 2000), (8, 2000), (5, 40)])
def test_collocations_against_plain_counts(spark, documents, least, top):
    want = phrases([(r["text"], r["lang"]) for r in documents.collect()], least, top)
    assert found_phrases(collocations.collocations(documents, least, top)) == want
    assert want or least == 100


def test_collocations_odd_and_empty(spark, odd_documents, empty_documents, monkeypatch):
    odd = [(100 + i, t, g, None) for i, (t, g) in enumerate([
        ("A b c, A b c. É É É\x0bx\x0cy É É É", "und"), ("a B c d e f a b c d e f", None), ("x\x00y \x1c z x\x00y \x1c z", "q"),
        ("no break no break no break", "q"), ("a a a a a a a a", "r"), ("the cat\tthe cat the\t\tcat", "")])]
    docs = odd_documents.select("doc_id", "text", "lang", "source").unionByName(
        spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    docs = docs.withColumns({"c": F.lit(1), "w1": F.lit("x"), "phrase": F.lit(None).cast("string"), "n": F.lit(2)})
    want = phrases([(r["text"], r["lang"]) for r in docs.collect()], 2, 500)
    assert found_phrases(collocations.collocations(docs, 2, 500)) == want and len(want) > 500
    monkeypatch.setattr(collocations, "COUNTED", 10)  # tasks hand on what they hold again and again
    monkeypatch.setattr(collocations, "HASHES", 10)
    assert found_phrases(collocations.collocations(docs, 2, 500)) == want
    assert collocations.collocations(empty_documents).collect() == []


def test_collocation_scores_pass_64_bits(spark):
    """Counts whose products need more than 64 bits keep exact scores."""
    counts = spark.createDataFrame([("en", "a", 1, 3 * 10 ** 11 + 1), ("en", "b", 1, 7 * 10 ** 11 + 3),
                                    ("en", "a b", 2, 2 * 10 ** 11 + 9)], "lang string, phrase string, words int, f long")
    sizes = spark.createDataFrame([("en", 10 ** 13 + 7)], "lang string, n long")
    r = collocations.ranked(counts, sizes, 10).collect()[0]
    assert r["score"] == 1000 * (2 * 10 ** 11 + 9) * (10 ** 13 + 7) // ((3 * 10 ** 11 + 1) * (7 * 10 ** 11 + 3))


def test_cover_tree_of_scattered_vectors_has_no_ball_for_every_point():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(3000, 64)))
    tree = negatives.CoverTree(x, rng.integers(0, 3, 3000), [(i,) for i in range(3000)])
    assert len(tree.count) < 3000 / 8
    least = sorted((x @ x[7]).tolist(), reverse=True)[30]
    scores = [(-int(v), i) for i, v in enumerate((x @ x[7]).tolist()) if i != 7]
    labels = dict(zip([i for one in tree.ids for i in one], tree.labels.tolist()))
    for same in (True, False):
        want = sorted(p for p in scores if (labels[p[1]] == 1) == same and -p[0] >= least)[:5]
        assert tree.search(x[7], 1, same, [(least, math.inf)], 5, 7)[0] == want
