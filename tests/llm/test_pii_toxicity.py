import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caremart.llm import pii, toxicity

SF = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


ODD = ["a@b.c_d@e.f x@y@z.w.v 1.2.3.4.5.6.7.8 999.1.1.1 007.000.0001.255 4111 1111-1111 1111 é \U0001f600 +49 (30) 1234-5678",
       "+1.2.3.4.5.6.7.8.9", "a@b a@b. @b.c %@x.y-z.-", "1" * 30_000 + " 4111111111111111 " + "a" * 30_000 + "@x.org",
       "0000000000001.1.1.1 1.2.3.256 +1234 5678 9 + 1 2", "4111-1111-1111-1111-1 4111  1111 1111 1111", "x\n+1 2\n3 4 5 6 7 8 9"]


def check(rows, docs):
    found = pii.find_spans(docs).select("doc_id", "base_spans", "all_spans").collect()
    assert len(found) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t or "")
    for r in found:
        want = base(texts[r["doc_id"]])
        assert [tuple(s) for s in r["base_spans"]] == want
        every = [tuple(s) for s in r["all_spans"]]
        assert set(want) <= set(every)
        assert every == sorted(every, key=lambda s: (pii.ALL_KINDS.index(s[0]), s[1]))


def test_base_spans_against_python(spark, documents):
    rows = list(enumerate(ODD)) + [(1000 + r["doc_id"], r["text"]) for r in documents.collect()]
    check(rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab1249.@+-_ ()\né")), max_size=60), min_size=20, max_size=60))
def test_base_spans_of_random_texts(spark, texts):
    rows = list(enumerate(texts))
    check(rows, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))


def masked(text, spans):
    """The runs of overlapping spans replaced by the kind of the longest one at their start."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_masked_text_against_python(spark):
    long = "x é\U0001f600 " * 3000
    rows = list(enumerate([*ODD, long + "a@b.de" + long + "1.2.3.4 +49 30 123456789" + long, "a@b.de", "1.2.3.4" * 2, "", None,
                           "é" * 4096 + "1.2.3.4", "é" * 4095 + " a@b.de " + "z" * 4090 + " 1.2.3.4", long]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find_spans(docs).withColumn("masked", pii.masked_text()).collect():
        want = masked(r["text"], [tuple(s) for s in r["all_spans"]]) if r["text"] is not None else None
        assert r["masked"] == want


def test_many_spans_in_one_text_take_linear_time(spark):
    """Twice the matches take about twice the time, for the spans and for the mask."""
    import time

    def seconds(n):
        text = " ".join(f"10.{i % 250}.{i % 7}.1 n{i}; 4111 1111 1111 1111; x{i}@y.org" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        r = pii.find_spans(docs).withColumn("masked", pii.masked_text()).collect()[0]
        assert len(r["base_spans"]) == 3 * n and r["masked"].count("[CARD]") == r["masked"].count("[EMAIL]") == n
        return time.time() - start
    seconds(1000)  # compiled
    few, many = seconds(10_000), seconds(40_000)
    assert many < 8 * few + 5  # quadratic time would be 16 times as much


def test_query_columns(spark):
    got = pii.query(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r["doc_id"]] or "")
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


def test_labelers_add_spans_and_leave_decoys(spark, documents):
    extra = ["call me (030) 555-1234 or john (at) mail [dot] com. 1 2", "version 999.1.1.1 of 2.0.", "4111111111111112"]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(
        [(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = {r["doc_id"]: r["all_spans"] for r in pii.find_spans(docs).filter("doc_id >= 10000").collect()}
    cut = lambda i: [extra[i][s["start"]:s["end"]] for s in got[10_000 + i]]
    assert cut(0) == ["john (at) mail [dot] com", "(030) 555-1234"] and cut(1) == [] and cut(2) == []


def test_em_finds_the_unreliable_labeler():
    yes, no, none = 1, -1, 0
    counts = [("email", (yes, yes, yes, yes, none, none), (0, 0, 0, 0), 90), ("email", (none, no, yes, none, no, no), (0, 0, 0, 0), 40),
              ("email", (yes, yes, yes, none, none, none), (0, 0, 0, 0), 30), ("email", (none, no, yes, none, none, no), (0, 0, 0, 0), 20)]
    belief = pii.expectation_maximisation(counts)
    assert belief["email", counts[0][1]] > 0.95 and belief["email", counts[1][1]] < 0.05
    weights = pii.train_classifier(counts)
    score = lambda c: sum(a * b for a, b in zip(weights["email"], pii._inputs("email", c[1], c[2])))
    assert score(counts[0]) > 0 > score(counts[1])


def test_masks(spark):
    docs = spark.createDataFrame([(1, "é \U0001f600 a@b.co, 1.2.3.4!"), (2, "none"), (3, None), (4, "1.2.3.4@x.org")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r["m"] for r in pii.find_spans(docs).select("doc_id", pii.masked_text().alias("m")).collect()}
    assert got == {1: "é \U0001f600 [EMAIL], [IP]!", 2: "none", 3: None, 4: "[EMAIL]"}


def test_odd_and_empty(odd_documents, empty_documents):
    out = pii.find_spans(odd_documents)
    assert out.count() == 11 and out.columns.count("all_spans") == 1
    assert pii.find_spans(empty_documents).collect() == []


def test_toxicity_on_held_out_labels(spark):
    rows = {r["doc_id"]: r for r in toxicity.query(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    held = [(rows[x["doc_id"]], x["toxic"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert np.mean([r["predicted"] == y for r, y in held]) >= 0.92
    assert sum(r["predicted"] for r, y in held if not y) == 0


def _fitted(texts, labels, penalty):
    row, feature = toxicity.text_features(texts)
    return toxicity.fit(row, feature, np.array(labels, float), penalty=penalty, clear=0.0)


def test_penalty_keeps_neutral_mentions_clean():
    # one group is named in most toxic texts, so a plain model blames its name
    texts = [f"the {g} people are {w} today number{i}" for i, (g, w) in enumerate(
        [("muslim", "scum")] * 30 + [("muslim", "kind")] * 4 + [("christian", "kind")] * 40 + [("jewish", "kind")] * 20)]
    labels = [1] * 30 + [0] * 64
    score = lambda w, t: float(w[toxicity.text_features([t])[1]].sum() + w[-1])
    plain, fair = _fitted(texts, labels, 0.0), _fitted(texts, labels, 20.0)
    gap = lambda w: score(w, "a muslim family") - score(w, "a christian family")
    assert gap(plain) > 1 and abs(gap(fair)) < 0.3 * gap(plain)
    assert score(fair, "they are scum") > 0 > score(fair, "a muslim family")


def test_toxicity_odd_inputs(spark, odd_documents, empty_documents):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (8, None), (5, 0)], "doc_id long, toxic int")
    out = toxicity.score(odd_documents, toxicity.train(odd_documents, labels)).collect()
    assert len(out) == 11 and len({r["score"] for r in out if r["doc_id"] in (1, 2, 3, 7)}) == 1
    none = toxicity.score(odd_documents, toxicity.train(odd_documents, labels.filter("false"))).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert toxicity.score(empty_documents, toxicity.train(empty_documents, labels)).collect() == []
    assert odd_documents.select(toxicity.held_out().alias("h")).filter(F.col("h").isNull()).count() == 0


def test_secrets_are_added_by_their_labelers(spark):
    """Keys and tokens are found by form and context; digests of commits and long words are not."""
    import random
    rnd = random.Random(8)
    code = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        key = code(40) if i % 2 else "AKIA" + code(16).upper()
        text = f"é config {i}: " + (f'token = "{key}"' if i % 2 else f"secret_key={key}") + " and more"
        rows.append((i, text))
        want[i] = [("secret", text.index(key), text.index(key) + len(key))]
        rows.append((100 + i, f"fixed in commit {code(40)} of the page, see checksum {code(32)}"))
        rows.append((200 + i, "averyveryverylongwordwithoutanynumbers internationalisation2024conference of words"))
        want[100 + i] = want[200 + i] = []
    got = {r["doc_id"]: [tuple(s) for s in r["all_spans"] if s["kind"] == "secret"]
           for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_fit_minimises_the_loss_over_explicitly_swapped_texts():
    """The loss written out: log-loss, ridge, and the squared change of the logit of every copy with one term swapped."""
    import random
    rnd = random.Random(6)
    kinds = (("muslim", "christian", "jewish"), ("old", "young"))
    words = ["scum", "kind", "idiots", "garden", "music", "awful"]
    texts, labels = [], []
    for i in range(60):
        own = rnd.sample(words, 2) + rnd.sample(["muslim", "christian", "jewish", "old", "young"], rnd.randrange(3))
        rnd.shuffle(own)
        texts.append(" ".join(own))
        labels.append(float("scum" in own or "idiots" in own) if rnd.random() < 0.9 else float("muslim" in own))
    row, feature = toxicity.text_features(texts)
    y, ridge, penalty = np.array(labels), 5e-3, 2.0
    w = toxicity.fit(row, feature, y, kinds=kinds, penalty=penalty, ridge=ridge, steps=4000, clear=0.5)
    used = np.flatnonzero(w[:-1])
    logit = lambda t, v: v[toxicity.text_features([t])[1]].sum() + v[-1]

    copies = []
    for t in texts:
        own = t.split()
        for kind in kinds:
            for term in set(own) & set(kind):
                copies += [(t, " ".join(o if x == term else x for x in own)) for o in kind if o != term and o not in own]

    # the same loss by plain gradient descent on the presence of each weighted feature
    present = lambda t: np.append(np.isin(used, toxicity.text_features([t])[1]).astype(float), 1.0)
    x = np.array([present(t) for t in texts])
    change = np.array([present(a) - present(b) for a, b in copies])
    free = np.append(np.ones(len(used)), 0.0)  # the bias is not shrunk

    def loss(v):
        z = x @ v
        return (np.mean(np.logaddexp(0, -z) + (1 - y) * z) + ridge / 2 * (free * v * v).sum()
                + penalty * ((change @ v) ** 2).sum() / len(texts))

    v = np.zeros(len(used) + 1)
    for _ in range(40_000):
        error = (1 / (1 + np.exp(-(x @ v))) - y) / len(texts)
        v -= 0.2 * (x.T @ error + ridge * free * v + 2 * penalty / len(texts) * change.T @ (change @ v))
    own = np.append(w[used], w[-1])
    assert copies and len(used) > 5 and logit(texts[0], w) == pytest.approx(x[0] @ own)
    assert loss(v) <= loss(own) < loss(v) + 1e-3
    assert np.abs(1 / (1 + np.exp(-(x @ own))) - 1 / (1 + np.exp(-(x @ v)))).max() < 0.01
    plain = toxicity.fit(row, feature, y, kinds=kinds, penalty=0.0, ridge=ridge, steps=4000, clear=0.5)
    assert loss(own) < loss(np.append(plain[used], plain[-1])) - 0.01


def test_neutral_mentions_before_and_after_the_penalty():
    """Counterfactual set: the same neutral sentence for each group; without the penalty the blamed groups are flagged."""
    rude, kind = ["scum", "idiots", "vermin"], ["kind", "busy", "asleep", "hungry"]
    texts = [f"the {g} people next door are {w} today number{i}" for i, (g, w) in enumerate(
        [("muslim", w) for w in rude * 12] + [("muslim", "kind")] * 3 + [("gay", w) for w in rude * 10] + [("gay", "busy")] * 3
        + [(g, w) for g in ("christian", "jewish", "straight", "lesbian") for w in kind * 5] + [("tall", w) for w in rude * 2 + kind * 90])]
    labels = [float(any(w in t.split() for w in rude)) for t in texts]
    flagged = {}
    for penalty in (0.0, 20.0):
        w = _fitted(texts, labels, penalty)
        p = lambda t: 1 / (1 + np.exp(-(w[toxicity.text_features([t])[1]].sum() + w[-1])))
        neutral = [p(f"a {g} family lives here") for g in ("muslim", "gay", "christian", "jewish", "straight", "lesbian")]
        flagged[penalty] = sum(x >= toxicity.THRESHOLD for x in neutral)
        assert all(p(f"the {g} people are {r}") >= toxicity.THRESHOLD for g in ("muslim", "christian") for r in rude)
    assert flagged[0.0] >= 2 and flagged[20.0] == 0, flagged
