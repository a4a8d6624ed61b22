import math
import os
from collections import Counter

import pytest
from helpers import rng

from cairn.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
TARGETS = "mix string, source string, weight double, max_repeats int, tokens int"


def run(spark, docs, targets, **options):
    d = spark.createDataFrame([(i, t, s, "clash") for i, (t, s) in enumerate(docs)], "doc_id bigint, text string, source string, copies string")
    t = spark.createDataFrame([(*x, 1) for x in targets], TARGETS)
    copies, shares = mixing.mixed(d, t, **options)
    return [r.asDict() for r in copies.collect()], {(r.mix, r.source): r.asDict() for r in shares.collect()}


def corpus():
    r = rng(8)
    sizes = {"big": 400, "mid": 100, "small": 12}
    return [(" word" * r.randrange(1, 60), s) for s, n in sizes.items() for _ in range(n)]


def test_shares_and_caps(spark):
    docs = corpus() + [(None, "big"), ("", "mid"), ("text of no source", None)]
    copies, shares = run(spark, docs, [("m", "big", 2.0, 1), ("m", "mid", 2.0, 3), ("m", "mid", 2.0, 3), ("m", "small", 1.0, 4), ("free", "big", 1.0, None), ("free", "small", 1.0, None)])
    for mix, want in (("m", {"big": 0.4, "mid": 0.4, "small": 0.2}), ("free", {"big": 0.5, "small": 0.5})):
        for s, share in want.items():
            assert abs(shares[mix, s]["share"] - share) < 0.02 and abs(shares[mix, s]["target_share"] - share) < 1e-9
    assert shares["m", "small"]["least_rate"] == 4 and shares["m", "small"]["most_copies"] == 4
    assert shares["m", "big"]["most_copies"] <= 1 and shares["m", "mid"]["most_copies"] <= 3
    assert all(c["copies"] > 0 for c in copies) and len({(c["mix"], c["doc_id"]) for c in copies}) == len(copies)
    used = Counter()
    for c in copies:
        used[c["mix"], c["source"]] += c["tokens"] * c["copies"]
    assert all(used[k] == v["tokens"] for k, v in shares.items())


def test_rates_are_tilted_by_length_and_meet_the_goal(spark):
    """The rates are those of the convex dual: min(cap, exp(dual x)), and mass = goal at the solution."""
    docs = corpus()
    copies, shares = run(spark, docs, [("m", "big", 1.0, 2), ("m", "mid", 4.0, 3), ("n", "big", 1.0, None), ("n", "mid", 1.0, None)])
    sizes = {}
    for c in copies:
        sizes[c["doc_id"]] = c["tokens"]
    for (mix, source), row in shares.items():
        assert row["converged"] and row["shortfall"] == 0
        if row["dual"] is not None:
            cap = row["max_repeats"] or math.inf
            own = [t.count(" word") for t, s in docs if s == source]
            mass = sum(t * min(cap, math.exp(row["dual"] * t / row["source_tokens"] * row["documents"])) for t in own)
            assert abs(mass / row["goal"] - 1) < 1e-6 and row["least_rate"] < row["most_rate"] <= cap
            assert abs(row["tokens"] - row["goal"]) < 60
    assert shares["m", "mid"]["dual"] is None and shares["m", "mid"]["least_rate"] == 3  # all it can give
    assert shares["n", "mid"]["dual"] > 0 > shares["n", "big"]["dual"]


def test_a_total_saturates_caps_and_reports_what_is_missing(spark):
    _, shares = run(spark, corpus(), [("m", "big", 1.0, None), ("m", "small", 1.0, 2)], total=20_000)
    big, small = shares["m", "big"], shares["m", "small"]
    assert abs(big["tokens"] - 10_000) < 60 and big["shortfall"] == 0
    assert small["tokens"] == 2 * small["source_tokens"] and small["shortfall"] == 10_000 - small["tokens"] and small["most_copies"] == 2


def test_one_source_with_equal_lengths(spark):
    _, shares = run(spark, [(" word" * 10, "a")] * 300 + [(" word" * 10, "b")] * 3, [("m", "a", 1.0, 2), ("m", "b", 1.0, 7)])
    assert shares["m", "a"]["tokens"] == shares["m", "b"]["tokens"] == 210


def test_sources_that_cannot_give(spark):
    targets = [("m", "big", 1.0, 1), ("m", "lost", 1.0, 1), ("m", "mid", 0.0, 1), ("m", "small", None, 1), (None, "big", 1.0, 1), ("m", None, 1.0, 1), ("n", "lost", 1.0, None), ("c", "big", 1.0, 0)]
    copies, shares = run(spark, corpus(), targets)
    assert {c["source"] for c in copies} == {"big"} and shares["m", "big"]["share"] == 1
    assert all(shares["m", s]["tokens"] == 0 for s in ("lost", "mid", "small")) and abs(shares["m", "lost"]["target_share"] - 0.5) < 1e-9
    assert shares["n", "lost"]["tokens"] == shares["c", "big"]["tokens"] == 0


def test_empty_tables(spark):
    assert run(spark, [], []) == ([], {})
    assert run(spark, corpus(), []) == ([], {})
    copies, shares = run(spark, [], [("m", "big", 1.0, 1)])
    assert copies == [] and shares["m", "big"]["tokens"] == 0
