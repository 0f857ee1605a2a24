"""Operator 7: personal data by weak supervision, with DataFrame functions only.

Candidates are matches of a strict and a loose pattern for each kind (e-mail address, IP address, card number, phone
number), and of a loose one for secrets (keys and tokens).  Six labelers vote on every candidate (yes, no or no vote): the strict rule; its shape; its checksum
or value range; a gazetteer (top-level domains, card issuers, calling codes, reserved networks); words before it; and
the characters it touches.  The votes of all documents are counted by pattern (at most 3^6 for each kind), and
expectation-maximisation on these counts estimates every labeler's reliability and each pattern's probability.  They
are the soft labels of the final classifier, a logistic regression on the span's votes and form, which scores each
candidate inside its document's row.

The spans of the strict rule (the base) always stand.  The classifier adds candidates at or above ``ACCEPT`` that
overlap no base span and whose checksum or range does not fail.  Digests look like secrets, so a secret also needs the
vote of its context or of the gazetteer (prefixes of known keys).

The documents are read twice, once for the counts and once for the result, and never shuffled; only the counts
of patterns are.  Matches are found by ``regexp_extract_all`` and placed by the gaps that ``split`` leaves, in code
points.  Patterns are possessive, so that no text makes them backtrack or recurse.

Defined cases: a null text is empty; a text without spans has counts 0, the empty string of spans and the SHA-256 of the
empty string; spans of different kinds may overlap; repeated rows are separate documents; an empty table gives an
empty result; columns of the documents named like an added one are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart.llm.common import read_table

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
ACCEPT = 0.9
CONTEXT = 24  # characters before a candidate that a labeler reads
BLOCK = 200  # array entries that are added up by copying
CHUNK = 4096  # code points of a long text that are counted through at once

STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": None,  # no strict rule names a secret
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+"
             r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?)[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Fa-f:])",
    "card": None,  # runs of digits that the strict rule drops are candidates already
    "phone": r"(?<![0-9+)(-])(?:00[1-9][0-9]{0,2}[\x20-]|\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20-])"
             r"(?:[0-9]{2,4}[\x20-]){1,3}[0-9]{2,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}+",
}
#: What can be true of a text with a candidate of the kind at all; a cheap test before the pattern.
NEEDS = {"email": r"@|[(\[{]at[)\]}]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][\x20-]?[0-9]",
         "phone": r"[0-9][\x20().-]*[0-9]", "secret": r"[A-Za-z0-9+/_-]{20}"}

GAZETTEER = {  # a candidate that matches it is known to be of its kind
    "email": r"(?i)(?:\.|dot[)\]}])\x20?(?:com|org|net|edu|gov|int|mil|info|biz|io|co|de|fr|es|uk|it|nl|eu|us|ca|au|jp|cn"
             r"|in|br|ru|ch|at|be|se|no|dk|fi|pl|pt)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]\.|2[3-5][0-9]\.).+$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:AKIA|ASIA|AIza|ghp_|gho_|glpat-|sk-|sk_live_|xox[abp]-|eyJ|ya29)",
}
BEFORE_YES = {
    "email": r"(?i)mail|contact|write|reach|correo|courriel|kontakt",
    "ip": r"(?i)\bip\b|host|server|address|login|from",
    "card": r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta",
    "phone": r"(?i)tel|phone|call|fax|mobile|cell|whatsapp|anruf|appel",
    "secret": r"(?i)token|secret|passw|pwd|credential|bearer|auth|(?:api|access|private|secret)[\x20_-]?key",
}
BEFORE_NO = r"(?i)commit|checksum|digest|sha-?[0-9]|md5|uuid|href|src=|version|\bv\.?$|isbn|issn|order|invoice|\bno\.?|nr\.?|number of|page|section|§|doi|figure|table"
#: Sizes of usual keys and digests, in hexadecimal or base 64.
SECRET_SIZES = (20, 24, 32, 36, 40, 44, 48, 64, 88, 96, 128)
LABELERS = ("rule", "shape", "check", "gazetteer", "before", "touch")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, add, start: Column, levels: int = 1) -> Column:
    """What ``add`` makes of all earlier values, for each value of an array.

    Arrays grow by copying, so values are added up inside blocks of ``BLOCK``, and so are the blocks' own results (with
    more ``levels``, in blocks again): 300,000 values take a few seconds.
    """
    def inside(block: Column) -> Column:
        kind = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, kind, lambda acc, x: F.struct(
            add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    if levels == 0:
        return inside(values)["out"]

    def from_blocks(all_values: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_values) - 1, F.lit(0)) / BLOCK).cast("int"))
        blocks = F.transform(cuts, lambda i: inside(F.slice(all_values, i * BLOCK + 1, BLOCK)))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(
            bs, _running(F.transform(bs, lambda b: b["at"]), add, start, levels - 1),
            lambda b, before: F.transform(b["out"], lambda x: add(before, x)))))
    return _let(values, from_blocks)


def _spans(text: Column, pattern: str, needs: str) -> Column:
    """The leftmost non-overlapping matches as structs of start, end, match, the text before and after."""
    empty = F.array().cast("array<struct<start:int,end:int,m:string,before:string,next:string>>")

    def placed(found: Column, gaps: Column) -> Column:
        parts = F.transform(found, lambda m, i: F.struct(
            m.alias("m"), F.length(m).alias("n"), F.get(gaps, i).alias("gap"),
            F.left(F.get(gaps, i + 1), F.lit(1)).alias("next")))

        def with_starts(xs: Column) -> Column:
            before = _running(F.transform(xs, lambda x: F.length(x["gap"]) + x["n"]), lambda a, x: a + x, F.lit(0))
            return F.zip_with(xs, before, lambda x, at: F.struct(
                (at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + x["n"]).alias("end"), x["m"].alias("m"),
                F.right(x["gap"], F.lit(CONTEXT)).alias("before"), x["next"].alias("next")))
        return _let(parts, with_starts)

    spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                 lambda found: _let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps)))
    return F.when(text.rlike(needs), spans).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """Whether a strict match passes its kind's check."""
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.when(
            F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
            .otherwise(False))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, 1)
    return (v.when(no, -1) if no is not None else v).otherwise(0)


def _votes(kind: str, strict: bool, s: Column) -> dict[str, Column]:
    m, n = s["m"], F.length(_digits(s["m"]))
    valid = _valid(kind, m) if strict else F.lit(False)
    shape = {"email": m.rlike(r"^[A-Za-z]") & (F.length(m) <= 80), "ip": ~m.rlike(r"(?:^|\.)0[0-9]"),
             "card": m.rlike(r"^(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})$"),
             "phone": m.rlike(r"[ ()-]"), "secret": m.rlike(r"[0-9].*[0-9].*[0-9].*[0-9]") & ~m.rlike(r"[A-Za-z]{9}")}[kind]
    check = {"email": _vote(F.length(m) >= 6), "ip": _vote(valid, ~valid) if strict else F.lit(1),
             "card": _vote(valid, ~n.between(13, 19) | ~valid),
             "phone": _vote(n.between(9, 13), ~n.between(7, 15)),
             "secret": _vote(F.length(m).isin(*SECRET_SIZES), F.length(m) > 512)}[kind]
    touch = F.right(s["before"], F.lit(1)).rlike(r"[A-Za-z0-9_.@/#=-]") | s["next"].rlike(r"[A-Za-z0-9_@/=]")
    return {"rule": _vote(valid) if strict else F.lit(0), "shape": _vote(shape, ~shape), "check": check,
            "gazetteer": _vote(m.rlike(GAZETTEER[kind])),
            "before": _vote(s["before"].rlike(BEFORE_YES[kind]), s["before"].rlike(BEFORE_NO)),
            "touch": _vote(F.right(s["before"], F.lit(1)).rlike("[\"'=:]") if kind == "secret" else F.lit(False), touch)}


def _form(s: Column) -> dict[str, Column]:
    """Marks of a span's form, beside its votes: its length and how much of it is digits."""
    n, d = F.length(s["m"]), F.length(_digits(s["m"]))
    return {"long": (n > 24).cast("int"), "short": (n < 9).cast("int"), "digits": (d * 2 > n).cast("int"),
            "spaced": s["m"].rlike("[ ()-]").cast("int")}


def _candidates(text: Column) -> Column:
    """All candidates of a text: kind, start, end, whether base, votes and form."""
    parts = []
    for kind in ALL_KINDS:
        for strict, pattern in ((True, STRICT[kind]), (False, LOOSE[kind])):
            if pattern is None:
                continue
            spans = _spans(text, pattern, NEEDS[kind])
            if kind == "card":
                spans = F.filter(spans, lambda s: F.length(_digits(s["m"])).between(12, 20))

            parts.append(F.transform(spans, _described(kind, strict)))
    return F.concat(*parts)


def _described(kind: str, strict: bool):
    def describe(s):
        votes = _votes(kind, strict, s)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        (_valid(kind, s["m"]) if strict else F.lit(False)).alias("base"),
                        *[votes[k].alias(k) for k in LABELERS], *[v.alias(k) for k, v in _form(s).items()])
    return describe


FORM = ("long", "short", "digits", "spaced")
ADDED = ("base_spans", "all_spans", "_c", "_base", "_all")


def vote_counts(docs: DataFrame) -> list[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
    """(kind, votes, form, candidates) over all documents: a bounded number of patterns, whatever the documents."""
    each = docs.select(F.explode(_candidates(F.coalesce("text", F.lit("")))).alias("c")).select("c.*")
    rows = each.groupBy("kind", *LABELERS, *FORM).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["kind"], tuple(r[k] for k in LABELERS), tuple(r[k] for k in FORM), r["n"]) for r in rows)


def expectation_maximisation(counts: list, rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """The probability of each (kind, votes) that the span is personal data, from the labelers' agreement.

    Each labeler has, for each kind and truth, a probability of each vote; it starts as a labeler that is right two
    times in three and is smoothed by one candidate.
    """
    out = {}
    for kind in ALL_KINDS:
        total: dict[tuple[int, ...], int] = {}
        for k, votes, _, n in counts:
            if k == kind:
                total[votes] = total.get(votes, 0) + n
        if not total:
            continue
        belief = {v: 1 / (1 + math.exp(-0.7 * sum(v))) for v in total}
        for _ in range(rounds):
            yes = sum(n * belief[v] for v, n in total.items())
            every = sum(total.values())
            prior = (yes + 1) / (every + 2)
            odds = {v: math.log(prior / (1 - prior)) for v in total}
            for j in range(len(LABELERS)):
                seen = {x: [1 / 3, 1 / 3] for x in (-1, 0, 1)}
                for v, n in total.items():
                    seen[v[j]][0] += n * belief[v]
                    seen[v[j]][1] += n * (1 - belief[v])
                for v in total:
                    a, b = seen[v[j]]
                    # a vote for a span never speaks against it, nor the other way round
                    ratio = math.log(a / (yes + 1)) - math.log(b / (every - yes + 1))
                    odds[v] += max(ratio, 0) if v[j] > 0 else min(ratio, 0) if v[j] < 0 else 0
            belief = {v: 1 / (1 + math.exp(-max(-30, min(30, o)))) for v, o in odds.items()}
        out.update({(kind, v): p for v, p in belief.items()})
    return out


def _inputs(kind: str, votes, form) -> list[float]:
    """The classifier's inputs: bias, yes and no votes of each labeler, and the form."""
    return [1.0, *[float(x > 0) for x in votes], *[float(x < 0) for x in votes], *map(float, form)]


def train_classifier(counts: list, steps: int = 400) -> dict[str, list[float]]:
    """Logistic regression for each kind on the counted patterns, with the EM probabilities as soft labels."""
    belief = expectation_maximisation(counts)
    out = {}
    for kind in ALL_KINDS:
        rows = [(_inputs(kind, v, f), belief[kind, v], n) for k, v, f, n in counts if k == kind]
        w = [0.0] * (1 + 2 * len(LABELERS) + len(FORM))
        total = sum(n for _, _, n in rows) or 1
        for _ in range(steps):
            grad = [1e-3 * x for x in w]
            for x, y, n in rows:
                p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
                for i, xi in enumerate(x):
                    if xi:
                        grad[i] += n / total * (p - y) * xi
            w = [a - 2.0 * g for a, g in zip(w, grad)]
        out[kind] = w if rows else [-30.0] + [0.0] * (len(w) - 1)
    return out


def _probability(c: Column, weights: dict[str, list[float]]) -> Column:
    def logit(w):
        terms = [F.lit(w[0])]
        terms += [F.when(c[k] > 0, w[1 + j]).when(c[k] < 0, w[1 + len(LABELERS) + j]).otherwise(0.0)
                  for j, k in enumerate(LABELERS)]
        terms += [c[k] * w[1 + 2 * len(LABELERS) + j] for j, k in enumerate(FORM)]
        return reduce(lambda a, b: a + b, terms)
    z = F.lit(-30.0)
    for kind in ALL_KINDS:
        z = F.when(c["kind"] == kind, logit(weights[kind])).otherwise(z)
    return 1 / (1 + F.exp(-z))


def find_spans(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """All columns of ``docs`` plus ``base_spans`` and ``all_spans``: arrays of kind, start, end, in order."""
    docs = docs.select(*[c for c in docs.columns if c not in ADDED])
    weights = train_classifier(vote_counts(docs))
    rows = docs.withColumn("_c", _candidates(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_base", F.filter("_c", lambda c: c["base"]))
    added = F.filter("_c", lambda c: F.when(c["base"], False).otherwise(
        (c["check"] >= 0) & ((c["kind"] != "secret") | (F.greatest(c["before"], c["gazetteer"]) > 0))
        & (_probability(c, weights) >= accept)
        & ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    rows = rows.withColumn("_all", F.concat("_base", F.when(F.size("_c") > F.size("_base"), added)
                                            .otherwise(F.slice("_c", 1, 0))))

    def ordered(name: str) -> Column:
        place = lambda kind: sum((F.when(kind == k, i).otherwise(0) for i, k in enumerate(ALL_KINDS)), F.lit(0))
        keyed = F.array_sort(F.transform(name, lambda c: F.struct(
            place(c["kind"]).alias("at"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
        return F.transform(keyed, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"),
                                                     c["end"].alias("end")))

    return rows.select(*docs.columns, ordered("_base").alias("base_spans"), ordered("_all").alias("all_spans"))


def spans_text(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked_text(text: str = "text", spans: str = "all_spans") -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in capitals and brackets.

    A run takes the kind of the longest span at its start.  The text is cut into chunks of ``CHUNK`` code points, so
    that no place is counted from the text's start.
    """
    t = F.col(text)
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("last"), s["end"].alias("end"), s["kind"].alias("kind"))))
    place = lambda at: F.floor(at / CHUNK).cast("int")

    def cut(chunks: Column, a: Column, b: Column) -> Column:
        """The code points from a to b."""
        one = F.substring(F.get(chunks, place(a)), a % CHUNK + 1, b - a)
        more = F.concat(F.substring(F.get(chunks, place(a)), a % CHUNK + 1, F.lit(CHUNK)),
                        F.array_join(F.slice(chunks, place(a) + 2, place(b) - place(a) - 1), ""),
                        F.coalesce(F.left(F.get(chunks, place(b)), b % CHUNK), F.lit("")))
        return F.when(b <= a, "").when(place(a) == place(b), one).otherwise(more)

    def masked(chunks: Column, sorted_spans: Column) -> Column:
        upto = _running(F.transform(sorted_spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
        pieces = F.zip_with(sorted_spans, upto, lambda s, at: F.when(s["start"] >= at, F.concat(
            cut(chunks, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), cut(chunks, F.array_max(F.transform(sorted_spans, lambda s: s["end"])),
                                                      F.length(t)))

    done = _let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)),
                lambda chunks: _let(in_order, lambda xs: masked(chunks, xs)))
    return F.when(F.size(spans) > 0, done).otherwise(t)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(spans_text("base_spans"), 256).alias("base_sha256"), spans_text("all_spans").alias("spans"),
                        (F.size("all_spans") - F.size("base_spans")).cast("long").alias("n_added"))
