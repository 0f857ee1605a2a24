import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caremart.llm import chat, mixing, tokens

SF = "/root/testdata/sf0.001"


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Water filling by repeated resharing, as the contract words it."""
    keys = sorted(sizes, key=lambda k: (k is None, k))
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    target, rest, free = {}, float(sum(sizes.values())), set(keys)
    while True:
        share = {k: rest * w[k] / sum(w[x] for x in free) for k in free}
        over = {k for k in free if share[k] > cap * sizes[k] + 1e-9}
        if not over:
            return target | share
        for k in over:
            target[k] = float(cap * sizes[k])
            rest -= target[k]
        free -= over


def test_mix_targets_and_words_taken(spark, documents):
    rows = mixing.mix_sources(documents).collect()
    sizes, first, taken, largest = {}, {}, {}, {}
    for r in rows:
        assert r["size"] == len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"] or "")])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        first[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    for source, target in fill(sizes).items():
        assert first[source] == pytest.approx(target)
        assert abs(taken[source] - target) <= largest[source] + 1
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix_sources(documents.repartition(7), salts=3).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}


def test_mix_of_null_and_repeated_ids_is_the_same_on_any_partitioning(spark):
    rows = [(None if i % 2 else i % 40, "s" if i % 3 else None, "w " * (9 + i % 2) + f"text {i % 700}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [sorted((str(r["doc_id"]), str(r["source"]), r["text"], r["copies"]) for r in mixing.mix_sources(
        docs.repartition(n).withColumn("_salt", F.lit(1))).collect()) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2000


def test_mix_caps_a_small_source(spark):
    rows = [(i, "b", "w " * 10) for i in range(30)] + [(100, "a", "w w"), (101, None, "w"), (102, "z", None)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    got = {r["source"]: r["target"] for r in out}
    assert got == pytest.approx(fill({"a": 2, "b": 300, "z": 0, None: 1}))
    assert {r["copies"] for r in out if r["source"] == "a"} == {3}
    assert {r["taken"] for r in out if r["source"] == "z"} == {0}


def test_mix_emits_each_copy_once(spark, documents):
    mixed = mixing.mix_sources(documents)
    copies = {r["doc_id"]: r["copies"] for r in mixed.collect() if r["copies"]}
    emitted = mixing.emit_copies(mixed).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("m"))
    assert {r["doc_id"]: (r["n"], r["m"]) for r in emitted.collect()} == {k: (v, v) for k, v in copies.items()}


def test_mix_odd_and_empty(odd_documents, empty_documents):
    out = mixing.mix_sources(odd_documents).collect()
    assert len(out) == 11 and {r["size"] for r in out if r["doc_id"] in (1, 2, 3, 7)} == {0}
    assert mixing.mix_sources(empty_documents).collect() == []


def _encoder():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))


def test_token_counts_equal_the_library(documents, odd_documents, empty_documents):
    encode = _encoder()
    for docs in (documents, odd_documents):
        for r in docs.select("doc_id", "text").join(tokens.token_counts(docs), "doc_id").distinct().collect():
            t = r["text"] or ""
            n = len(encode.encode(t, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)
    assert tokens.token_counts(odd_documents).count() == 11
    assert tokens.token_counts(empty_documents).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab.,'\n\t    é1%<|>", "<|endoftext|>", "'s", "...", "word"]), max_size=60))
def test_safe_cuts_add_up(parts):
    text = "".join(parts)
    encode = _ENCODER[0] if _ENCODER else _ENCODER.append(_encoder()) or _ENCODER[0]
    count = lambda t: len(encode.encode(t, add_special_tokens=False).ids)
    if tokens.UNSAFE.search(text):
        return
    first, *words = text.split(" ")
    assert count(first) + sum(count(" " + w) for w in words) == count(text)


_ENCODER: list = []


def test_chat_equals_sql_and_masks_own_words(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.perspectives(turns).collect()}
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    names = ["conv_id", "speaker", "part", "n_turns", "n_target_chars", "rendered", "mask"]
    want = con.sql(f"select {', '.join(names)} from ({chat.SQL})").fetchall()
    assert sorted(tuple(r[n] for n in names) for r in rows.values()) == sorted(want)
    texts = {}
    for t in turns.orderBy("conv_id", "turn").collect():
        texts.setdefault((t["conv_id"], t["role"]), []).append(t["text"])
    for (conv, speaker, _), r in rows.items():
        own = [r["rendered"][int(a):int(b)] for a, b in (m.split(":") for m in r["mask"].split(",") if m)]
        assert own == [t for t in texts[conv, speaker] if t]


def test_chat_parts_ties_nulls_and_long_conversations(spark):
    rows = [(1, i, f"p{i % 3}", f"t{i}") for i in range(200)] + [(2, 0, "system", "s"), (3, None, None, None),
                                                                (3, 1, "b", "x"), (3, 1, "b", "x"), (None, 0, "a", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    out = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.perspectives(turns, per_part=64).collect()}
    assert {k for k in out if k[0] == 1} == {(1, f"p{p}", k) for p in range(3) for k in range(4)}
    assert sum(out[1, "p0", k]["n_turns"] for k in range(4)) == 200
    assert not any(k[0] == 2 for k in out)  # system turns only
    assert out[3, "b", 0]["n_turns"] == 3 and out[3, "unknown", 0]["mask"] == ""
    assert out[None, "a", 0]["rendered"] == "<|assistant|>\nn<|end|>\n"
    assert chat.perspectives(turns.filter("false")).collect() == []
