"""Token replay against a plain replay by hand and by brute force, with branching, parallel and cyclic nets."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.operators import conformance as C

COLUMNS = "case_id string, activity string, started_at long, event_id long, missing long"


def log(spark, cases):
    rows = [(c, a, i // 2, i, 9) for c, acts in cases.items() for i, a in enumerate(acts)]
    rng = np.random.default_rng(1)
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))] if rows else [], COLUMNS).repartition(4)


def counts(spark, cases, net):
    return {r.case_id: (r.events, r.unknown, r.produced, r.consumed, r.missing, r.remaining, r.fitness) for r in C.replayed(log(spark, cases), net).collect()}


def test_sequence_by_hand(spark):
    net = C.net_of([("a", "b"), ("b", "c")])
    got = counts(spark, {"fits": "abc", "skips": "ac", "twice": "abbc", "alien": "axbc", "stops": "a"}, net)
    assert got["fits"] == (3, 0, 4, 4, 0, 0, 1.0)
    assert got["skips"] == (2, 0, 3, 3, 1, 1, round(1 - 1 / 3, 6))
    assert got["twice"] == (4, 0, 5, 5, 1, 1, 0.8)
    assert got["alien"] == (4, 1, 4, 4, 0, 0, 1.0)
    assert got["stops"] == (1, 0, 2, 2, 1, 1, 0.5)


def test_parallel_branches_need_both(spark):
    flows = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    both, either = C.net_of(flows, parallel=["a"], joins=["d"]), C.net_of(flows)
    assert {k: v[4:6] for k, v in counts(spark, {1: "abcd", 2: "acbd", 3: "abd"}, both).items()} == {"1": (0, 0), "2": (0, 0), "3": (1, 1)}
    assert {k: v[4:6] for k, v in counts(spark, {1: "abcd", 3: "abd", 4: "acd"}, either).items()} == {"1": (1, 1), "3": (0, 0), "4": (0, 0)}


def plain(net, acts):
    """(events, unknown, produced, consumed, missing, remaining), and for each step behind a fitting prefix what is enabled."""
    tokens, p, c, m, unknown, seen = Counter(net.start), len(net.start), 0, 0, 0, []
    for k, a in enumerate(acts):
        if not m and not unknown:
            seen.append((tuple(acts[:k]), a, {x for x, ways in net.transitions.items() for w in ways if all(tokens[i] > 0 for i in w.inputs)}))
        if a not in net.transitions:
            unknown += 1
            continue
        lack = [sum(tokens[i] < 1 for i in w.inputs) for w in net.transitions[a]]
        w = net.transitions[a][lack.index(min(lack))]
        for i in w.inputs:
            m, c = m + (tokens[i] < 1), c + 1
            tokens[i] = max(0, tokens[i] - 1)
        for o in w.outputs:
            tokens[o] += 1
            p += 1
    lack = [sum(tokens[i] < 1 for i in w.inputs) for w in net.ends]
    for i in net.ends[lack.index(min(lack))].inputs:
        m, c = m + (tokens[i] < 1), c + 1
        tokens[i] = max(0, tokens[i] - 1)
    return (len(acts), unknown, p, c, m, sum(tokens.values())), seen


@pytest.mark.parametrize("parallel", [(), ("b",)])
def test_brute_force(spark, parallel):
    rng = np.random.default_rng(len(parallel))
    net = C.net_of([("a", "b"), ("b", "c"), ("b", "d"), ("c", "e"), ("d", "e"), ("e", "b"), ("e", "f")], parallel, parallel and ("e",))
    cases = {str(i): [str(x) for x in rng.choice(list("abcdefz"), int(rng.integers(1, 12)), p=[0.2, 0.2, 0.15, 0.15, 0.15, 0.1, 0.05])] for i in range(120)}
    cases |= {f"good{i}": list("abcebdef" if not parallel else "abcdebdcef") for i in range(30)} | {"long": list("abce" + "bdebce" * 3000 + "f")}
    want = {c: plain(net, acts) for c, acts in cases.items()}
    got = counts(spark, cases, net)
    assert {c: v[:6] for c, v in got.items()} == {c: w[0] for c, w in want.items()}
    states, nexts = Counter(), defaultdict(set)
    allowed = {}
    for _, seen in want.values():
        for prefix, a, enabled in seen:
            states[prefix] += 1
            nexts[prefix].add(a)
            allowed[prefix] = enabled
    precision = sum(n * len(nexts[s] & allowed[s]) for s, n in states.items()) / sum(n * len(allowed[s]) for s, n in states.items())
    done = Counter(a for acts in cases.values() for a in acts)
    p, c, m, r = (sum(w[0][k] for w in want.values()) for k in (2, 3, 4, 5))
    (row,) = C.conformance(log(spark, cases), net).collect()
    assert row.cases == len(cases) and row.fitting == sum(w[0][4:] == (0, 0) and not w[0][1] for w in want.values())
    assert row.fitness == pytest.approx((1 - m / c) / 2 + (1 - r / p) / 2, abs=2e-6)
    assert row.precision == pytest.approx(precision, abs=2e-6)
    assert row.generalization == pytest.approx(1 - np.mean([max(done[a], 1) ** -0.5 for a in net.transitions]), abs=2e-6)
    assert row.deviations == 1 and C.deviations(log(spark, cases), net).collect() == [("z", done["z"])]


def test_empty_log_and_null_rows(spark):
    net = C.net_of([("a", "b")])
    (row,) = C.conformance(log(spark, {}), net).collect()
    assert (row.cases, row.fitness, row.precision, row.deviations) == (0, 1.0, 1.0, 0)
    rows = spark.createDataFrame([(None, "a", 1, 1, 0), ("c", None, 1, 2, 0), ("c", "a", None, 3, 0), ("c", "b", 5, 4, 0)], COLUMNS)
    assert [(r.case_id, r.events, r.unknown, r.missing) for r in C.replayed(rows, net).collect()] == [("c", 3, 1, 0)]


def test_model_from_edges(spark):
    edges = spark.createDataFrame([("act:a", "act:b", "FLOW_TO"), ("act:a", "act:b", "FLOW_TO"), ("act:b", None, "FLOW_TO"), ("x", "y", "CALLS")], "src string, dst string, edge_type string")
    assert C.model(edges) == [("a", "b")]
