"""Operators against plain Python, and limits that raise."""

import hashlib
import hmac
import random
import re
from dataclasses import replace
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainframe.functions import exact, pricing, text
from chainframe.operators import cells, clock, graph, guards, learning, ordered, paging, prefix, quality, replay, research, roundtrips
from chainframe.plans import registry

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUICK
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), min_size=1, max_size=40))
def test_cooldown_is_greedy(spark, rows):
    data = [(k, t, i) for i, (k, t) in enumerate(rows)]
    got = {r["id"] for r in replay.cooldown(spark.createDataFrame(data, "k long, t long, id long"), "k", "t", 10, "id").collect()}
    want, last = set(), {}
    for k, t, i in sorted(data, key=lambda r: (r[1], r[2])):
        if k not in last or t >= last[k] + 10:
            last[k] = t
            want.add(i)
    assert got == want


@QUICK
@given(st.lists(st.integers(0, 8), min_size=2, max_size=20).filter(lambda c: sum(c) >= 2), st.integers(1, 12))
def test_clock_equals_naive_expansion(spark, counts, n):
    frame = spark.createDataFrame(list(enumerate(counts)), "block_ordinal long, transaction_count long")
    built = clock.build_clock(frame)
    places = [(b, i) for b, c in enumerate(counts) for i in range(c)]
    assert {(r["block_ordinal"], r["prefix"]) for r in built.collect()} == {(b, sum(counts[:b])) for b in range(len(counts))}
    got = clock.after_transactions(spark.createDataFrame(places, "block_ordinal long, transaction_index long"), built, n, width=3)
    want = {(*places[i], *places[i + n]) for i in range(len(places) - n)}
    assert {(r["block_ordinal"], r["transaction_index"], r["landing_block"], r["landing_index"]) for r in got.collect()} == want


@QUICK
@given(st.lists(st.tuples(st.integers(100_000, 10_000_000_000), st.integers(10**12, 10**15), st.integers(10**9, 10**12)), min_size=1, max_size=20))
def test_a_buy_never_exceeds_its_budget(spark, rows):
    df = spark.createDataFrame(rows, "g long, vt long, vq long")
    for r in df.select("g", "vt", "vq", pricing.buy_quote(F.col("g"), F.col("vt"), F.col("vq"), F.col("vt")).alias("q")).collect():
        net = r["g"] * 10_000 // 10_125
        net -= max(0, net + -(-net * 95 // 10_000) + -(-net * 30 // 10_000) - r["g"])
        assert int(r["q"]["net"]) == net and int(r["q"]["net"] + r["q"]["fees"]) <= r["g"]
        assert int(r["q"]["out"]) == (max(0, net - 1) * r["vt"]) // (r["vq"] + max(0, net - 1))


@QUICK
@given(st.lists(st.tuples(st.integers(-(10**20), 10**20), st.integers(1, 10**9)), min_size=1, max_size=20))
def test_floor_division(spark, rows):
    df = spark.createDataFrame([(str(a), str(b)) for a, b in rows], "a string, b string")
    got = df.select("a", "b", exact.floordiv(F.col("a"), F.col("b")).cast("string").alias("q")).collect()
    assert all(int(r["q"]) == int(r["a"]) // int(r["b"]) for r in got)


def test_base58_round_trip(spark):
    values = [b"", b"\0\0a", bytes(range(32)), b"\xff" * 64]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "b binary")
    got = df.select("b", text.base58_decode(text.base58_encode("b")).alias("back")).collect()
    assert all(bytes(r["b"]) == bytes(r["back"]) for r in got)


@pytest.mark.parametrize("width", [None, 4])
@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, forward, width):
    rng = random.Random(4)
    left = [(rng.randrange(3), rng.randrange(50), i) for i in range(60)]
    right = [(rng.randrange(3), rng.randrange(50), i) for i in range(40)]
    got = ordered.asof(spark.createDataFrame(left, "k long, a long, i long"), spark.createDataFrame(right, "k long, b long, v long"), ["k"], "a", "b", ["v"], forward, width)
    for r in got.collect():
        fits = [(b, v) for k, b, v in right if k == r["k"] and (b >= r["a"] if forward else b <= r["a"])]
        best = (min(b for b, _ in fits) if forward else max(b for b, _ in fits)) if fits else None
        assert r["v"] in ({v for b, v in fits if b == best} if fits else {None})


def test_pairs_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(5)
    rows = [(b := rng.randrange(40), i, 0, b * 86_400, rng.randrange(8), "BUY" if rng.random() < 0.8 else "SELL", 1, 1, rng.randrange(12)) for i in range(400)]
    schema = "block_ordinal long, transaction_index long, source_instruction_index long, block_time_s long, mint long, side string, base_amount long, quote_amount long, signing_wallet long"
    firsts = {}
    for r in sorted(rows):
        if r[5] == "BUY":
            firsts.setdefault((r[8], r[4]), r)
    want = {}
    for (a, m), x in firsts.items():
        for (b, n), y in firsts.items():
            if m == n and a < b and abs(x[3] - y[3]) <= 5 * 86_400:
                want[a, b] = want.get((a, b), 0) + 1
    for parts in (1, 7):
        rng.shuffle(rows)
        obs = spark.createDataFrame(rows, schema).repartition(parts)
        got = research.pair_counts(research.matches(research.first_buys(obs), 5 * 86_400), 1)
        assert {(r["signer_a"], r["signer_b"]): r["shared_mints"] for r in got.collect()} == want


def test_limits_raise(spark):
    with pytest.raises(guards.LimitExceeded):
        guards.guard_rows(spark.range(11), 10)
    firsts = spark.createDataFrame([(1, w) for w in range(9)], "mint long, signing_wallet long")
    with pytest.raises(guards.LimitExceeded):
        research.guarded(firsts, 5, None)
    with pytest.raises(ValueError):
        guards.guard_unique(spark.createDataFrame([(1,), (1,)], "k long"), "k")


def test_digest_of_rows_ignores_their_order(spark):
    rows = [(i, str(i * 7)) for i in range(50)]
    digests = {quality.unordered_digest(spark.createDataFrame(random.Random(s).sample(rows, 50), "a long, b string").repartition(s + 1), "a", "b").first()["digest"] for s in range(3)}
    assert len(digests) == 1


def test_cursor_is_bound_to_its_view_and_secret():
    cursor = paging.encode_cursor("jobs", (3, "x"), b"s")
    assert paging.decode_cursor("jobs", cursor, b"s") == (3, "x")
    for view, secret in (("runs", b"s"), ("jobs", b"t")):
        with pytest.raises(ValueError):
            paging.decode_cursor(view, cursor, secret)


def test_keyed_random_is_an_hmac(spark):
    for seed in ("s", "seed " * 40):
        got = spark.range(5).select("id", text.keyed_random(seed, "delay", F.col("id")).alias("x")).collect()
        assert [int(r["x"]) for r in got] == [int.from_bytes(hmac.new(seed.encode(), f"delay\0{r['id']}".encode(), hashlib.sha256).digest()[:8], "big") for r in got]


def test_first_block_after_a_time(spark):
    rng = random.Random(6)
    times = sorted(rng.randrange(0, 400) for _ in range(60))
    frame = spark.createDataFrame([(b, rng.choice([0, 0, 1, 5]), t) for b, t in enumerate(times)], "block_ordinal long, transaction_count long, block_time_s long")
    blocks = [tuple(r) for r in frame.collect()]
    wanted = [(i, times[a] + rng.randrange(0, 150), a) for i, a in enumerate(rng.randrange(60) for _ in range(200))]
    asked = spark.createDataFrame(wanted, "id long, due long, after long").repartition(7, "due")
    got = {r["id"]: r["found_block"] for r in clock.first_block_at(asked, frame, "id", "due", "after", width=20).collect()}
    assert got == {i: min((b for b, n, t in blocks if n and t >= due and b > after), default=None) for i, due, after in wanted}


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_forward_frames_grow(spark):
    """A frame that reaches to the end of its range is read again for every row of it."""
    left, right = spark.range(9).selectExpr("id AS a"), spark.range(9).selectExpr("id * 2 AS b", "id AS v")
    assert "unboundedfollowing" not in _plan(ordered.asof(left, right, [], "a", "b", ["v"], True, 4)).lower()
    rows = [(r, r if r % 5 == 0 else None) for r in (*range(0, 60), *range(9000, 9060, 3))]
    frame = spark.createDataFrame(rows, "r long, v long")
    got = prefix.carried(frame, [], "r", "v", forward=True)
    assert "unboundedfollowing" not in _plan(got).lower()
    assert {r["r"]: r["_carried"] for r in got.collect()} == {r: min((v for _, v in rows if v is not None and v > r), default=None) for r, _ in rows}


def test_equal_times_are_looked_up_once(spark):
    frame = spark.createDataFrame([(b, 1, b * 60) for b in range(50)], "block_ordinal long, transaction_count long, block_time_s long")
    asked = spark.createDataFrame([(i, 600, 9) for i in range(400)], "id long, due long, after long")
    found = clock.first_block_at(asked, frame, "id", "due", "after")
    assert [r["found_block"] for r in found.collect()] == [10] * 400
    assert max(int(n) for n in re.findall(r"number of output rows: (\d+)", _with_rows(found))) == 400


def _with_rows(df):
    """The rows that each step of the plan that ran has put out."""

    def down(plan):
        metrics = plan.metrics()
        own = f"{plan.nodeName()} number of output rows: {metrics.apply('numOutputRows').value()}\n" if metrics.contains("numOutputRows") else ""
        parts = [plan.children().apply(i) for i in range(plan.children().size())]
        if "AdaptiveSparkPlan" in plan.nodeName():
            parts = [plan.executedPlan()]
        elif "QueryStage" in plan.nodeName():
            parts = [plan.plan()]
        return own + "".join(map(down, parts))

    return down(df._jdf.queryExecution().executedPlan())


def test_the_clock_is_not_broadcast(spark):
    """Integers that are written out from one row look small to the planner."""
    counts = spark.createDataFrame([(0, 3), (70_000, 2)], "block_ordinal long, transaction_count long")
    made = clock.build_clock(counts)
    assert [tuple(r) for r in made.where("transaction_count > 0").orderBy("block_ordinal").collect()] == [(0, 3, 0), (70_000, 2, 3)]
    assert "(strategy=merge)" in made._jdf.queryExecution().optimizedPlan().toString()


def test_running_sums_over_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(3), rng.randrange(0, 40_000), i, rng.randrange(-5, 9)) for i in range(500)]
    frame = spark.createDataFrame(rows, "k long, a long, i long, v long")
    for inclusive in (True, False):
        got = {r["i"]: r["s"] for r in prefix.running_sum(frame, ["k"], "a", ["i"], "v", "s", width=7, inclusive=inclusive).collect()}
        assert got == {i: sum(w for m, b, j, w in rows if m == k and ((b, j) <= (a, i) if inclusive else (b, j) < (a, i))) for k, a, i, _ in rows}


def test_ordinals_and_ordered_digests(spark):
    rows = [(i * 7919 % 3000,) for i in range(3000)]
    for parts in (1, 5):
        frame = spark.createDataFrame(rows, "v long").repartition(parts)
        assert {(r["v"], r["row_id"]) for r in research.global_ordinal(frame, ["v"], parts=parts + 2).collect()} == {(i, i) for i in range(3000)}
        digest = quality.ordered_digest(frame, ["v"], "v").first()
        assert digest["n"] == 3000
        level = [hashlib.sha256(f'{{"v":{i}}}'.encode()).hexdigest() for i in range(3000)]
        for _ in range(3):
            level = [hashlib.sha256("".join(level[i : i + 1024]).encode()).hexdigest() for i in range(0, len(level), 1024)]
        assert digest["digest"] == hashlib.sha256(("stream\0" + "".join(level)).encode()).hexdigest()


def test_closure_of_a_deep_chain(spark):
    parents = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(3, 0), (100, 101)], "child long, parent long")
    got = graph.closure(spark.createDataFrame([(0,)], "node long"), parents)
    assert sorted(r["node"] for r in got.collect()) == list(range(61))
    with pytest.raises(ValueError):
        graph.closure(spark.createDataFrame([(0,)], "node long"), spark.createDataFrame([(i, i + 1) for i in range(70)], "child long, parent long"))


def _moved(edges, passes=20):
    """Local moving on plain dictionaries; modularity is counted anew for every choice."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    group = {x: x for x in nodes}
    weight = sum(w for _, _, w in edges)

    def value():
        inside = sum(w for a, b, w in edges if group[a] == group[b])
        mass = {}
        for a, b, w in edges:
            for x in (a, b):
                mass[group[x]] = mass.get(group[x], 0) + w
        return inside / weight - sum((m / (2 * weight)) ** 2 for m in mass.values())

    for _ in range(passes):
        before = dict(group)
        for x in nodes:
            own = best = group[x]
            most = value()
            for g in sorted({group[b if a == x else a] for a, b, _ in edges if x in (a, b)} - {own}):
                group[x] = g
                if (now := value()) > most + 1e-9 / weight:
                    best, most = g, now
            group[x] = best
        if group == before:
            break
    return group, value()


def test_communities_by_modularity_counted_anew(spark):
    rng = random.Random(8)
    for trial in range(4):
        cliques = [(a + 10 * c, b + 10 * c, rng.randrange(1, 4)) for c in range(3) for a in range(6) for b in range(a + 1, 6) if rng.random() < 0.8]
        edges = cliques + [(rng.randrange(6), 10 + rng.randrange(6), 1), (10 + rng.randrange(6), 20 + rng.randrange(6), 1)]
        frame = spark.createDataFrame(edges, "signer_a long, signer_b long, weight long")
        groups = graph.communities(frame)
        want, value = _moved(edges)
        assert {r["node"]: r["label"] for r in groups.collect()} == want
        assert abs(graph.modularity(frame, groups) - value) < 1e-9
    with pytest.raises(guards.LimitExceeded):
        graph.communities(frame, most_edges=3)


def _trade(block, tx, second, mint, wallet, side="BUY", amount=1):
    return (block, tx, 0, second, mint, side, amount, amount, wallet)


OBS = "block_ordinal long, transaction_index long, source_instruction_index long, block_time_s long, mint string, side string, base_amount decimal(20,0), quote_amount decimal(20,0), signing_wallet string"


def test_wallet_research_fixture(spark):
    """Seven rows: A and B buy one mint in one transaction and another a minute apart; C is busy on its own."""
    big = 10**18 + 1
    rows = [_trade(1, 0, 100, "m", "A"), (1, 0, 1, 100, "m", "BUY", 1, 1, "B"), _trade(2, 4, 160, "n", "A"), _trade(3, 0, 220, "n", "B"), *(_trade(9, i, 999, "o", "C", amount=big) for i in range(3))]
    frame = spark.createDataFrame([(*r[:6], Decimal(r[6]), Decimal(r[7]), r[8]) for r in rows], OBS)
    numbered = research.global_ordinal(frame, research.POSITION, "observation_id")
    assert numbered.count() == 7
    for window, pairs in ((60, [("A", "B", 2, 1, 0, 1)]), (59, [])):
        found = research.matches(research.first_buys(numbered), window)
        counts = research.pair_counts(found, 2)
        assert [tuple(r) for r in counts.collect()] == pairs
        ranged = research.with_evidence_ranges(counts)
        assert [(r["row_id"], r["evidence_start"], r["evidence_count"]) for r in ranged.collect()] == [(0, 0, 2)] * len(pairs)
        rows_ = [(r["row_id"], r["pair_row_id"], r["mint"], r["left_observation"], r["right_observation"], r["delta_seconds"]) for r in research.evidence_rows(found, ranged).orderBy("row_id").collect()]
        assert rows_ == ([(0, 0, "m", 0, 1, 0), (1, 0, "n", 2, 3, 60)] if pairs else [])
    busy = research.activity(frame).where("signing_wallet = 'C'").first()
    assert (busy["buy_rows"], busy["mint_count"], int(busy["quote_buy"])) == (3, 1, 3 * big)
    empty = research.matches(research.first_buys(numbered.limit(0)), 60)
    assert research.pair_counts(empty, 1).count() == 0 and research.with_evidence_ranges(research.pair_counts(empty, 1)).count() == 0


def test_exact_ridge(spark):
    rows = spark.createDataFrame([(i, i * i % 17, 5 + 2 * i - 3 * (i * i % 17)) for i in range(30)], "a long, b long, y long")
    assert learning.ridge(learning.gram(rows, ["a", "b"], "y"), 0) == [Fraction(5), Fraction(2), Fraction(-3)]


def test_funds_are_never_negative(spark):
    rows = [(1, i, -3 if i % 2 else 2) for i in range(20)]
    got = replay.funded(spark.createDataFrame(rows, "w long, i long, x long"), "w", ["i"], "x", 4).orderBy("i").collect()
    left = 4
    for r in got:
        assert r["accepted"] == (left + r["x"] >= 0)
        left += r["x"] if r["accepted"] else 0
        assert left >= 0


def test_logistic_steps_equal_a_plain_loop():
    import math

    import numpy as np

    rng = random.Random(9)
    x = [rng.gauss(3, 2) for _ in range(40)]
    y = [1.0 if a + rng.gauss(0, 1) > 3 else 0.0 for a in x]
    mean, spread, w = learning.logistic_steps(np.array(x)[:, None], np.array(y))
    m = sum(x) / 40
    s = math.sqrt(sum((a - m) ** 2 for a in x) / 40)
    b, k = 0.0, 0.0
    for _ in range(400):
        p = [1 / (1 + math.exp(-(b + k * (a - m) / s))) for a in x]
        gb = sum(q - t for q, t in zip(p, y, strict=True)) / 40
        gk = sum((q - t) * (a - m) / s for q, t, a in zip(p, y, x, strict=True)) / 40 + 0.01 * k
        b, k = b - 0.15 * gb, k - 0.15 * gk
    assert abs(w[0] - b) < 1e-9 and abs(w[1] - k) < 1e-9 and abs(mean[0] - m) < 1e-9 and abs(spread[0] - s) < 1e-9


def test_models_are_fitted_per_period(spark):
    rows = spark.createDataFrame([(p, a, b, 5 + p * a - b) for p in (1, 2) for a in range(6) for b in range(3)], "p long, a long, b long, y long")
    assert {p: learning.ridge(g, 0) for p, g in learning.grams_by(rows, "p", ["a", "b"], "y").items()} == {1: [5, 1, -1], 2: [5, 2, -1]}
    features = spark.createDataFrame([(1, 10, 100, 4, 1), (2, 25, 300, 4, 1), (3, 99, 300, 4, 1)], "replay_row_id long, block_ordinal long, available long, v0 long, v1 long")
    schedule = spark.createDataFrame([(1, 0, 20), (2, 20, 30)], "model int, lo long, hi long")
    models = spark.createDataFrame([(1, 200, 5, 1, -1), (2, 250, 5, 2, -1)], "model int, fitted long, w0 long, w1 long, w2 long")
    got = sorted(tuple(r) for r in learning.predictions(features, schedule, models, 3, 7).collect())
    assert got == [(1, 1, 207, 2), (2, 2, 307, 4), (3, None, 307, None)]


def test_transitions_of_a_curve(spark):
    rows = [("a", 1, 5, 5, "ACTIVE"), ("a", 2, 5, 5, "COMPLETED"), ("a", 3, 5, 5, "MIGRATED"), ("b", 1, 5, 5, "ACTIVE"), ("b", 2, 5, 5, "MIGRATED"), ("b", 3, 5, 5, "ACTIVE"), ("c", 1, 0, 5, "ACTIVE")]
    states = spark.createDataFrame(rows, "venue string, state_at long, vt long, vq long, lifecycle string")
    assert {(r["venue"], r["state_at"]) for r in replay.transition_errors(states).collect()} == {("b", 2), ("b", 3), ("c", 1)}


TERMS = roundtrips.Terms(budget=100, opening=500, cooldown_s=10, buy_delay=1, hold_s=1, sell_delay=1, buy_slippage_bps=0, sell_slippage_bps=0, buy_fee=7, sell_fee=5, mint_deposit=20, wallet_deposit=30)


def _run(acts, terms):
    """A wallet as plain books: every amount is moved between accounts, which must add up to nothing."""
    books = {"AVAILABLE": terms.opening, "RESERVED": 0, "SPENT": 0, "FEES": 0, "LOCKED": 0}
    owner, state, out = None, {}, {}

    def move(a, b, n):
        books[a] -= n
        books[b] += n
        assert min(books["AVAILABLE"], books["RESERVED"], books["LOCKED"]) >= 0

    for _, _, _, trip, kind, spent, buy_ok, decide_ok, sell_ok, proceeds in sorted(acts):
        flow = state.get(trip)
        if kind == 0:
            own = terms.wallet_deposit if owner is None else 0
            need = terms.budget + terms.buy_fee + terms.mint_deposit + own
            if books["AVAILABLE"] < need:
                out[trip] = ("BUY_PRE_SUBMIT_INSUFFICIENT_FUNDS", 0, 0)
            else:
                move("AVAILABLE", "RESERVED", need)
                state[trip] = {"reserved": need, "own": own, "cash": 0}
        elif flow and kind == 1:
            if not buy_ok:
                move("RESERVED", "FEES", terms.buy_fee)
                move("RESERVED", "AVAILABLE", flow["reserved"] - terms.buy_fee)
                out[trip] = ("BUY_LANDED_FAILED", -terms.buy_fee, 0)
                del state[trip]
                continue
            paid = flow["own"] if owner is None else 0
            owner = trip if paid else owner
            move("RESERVED", "SPENT", spent)
            move("RESERVED", "FEES", terms.buy_fee)
            move("RESERVED", "LOCKED", terms.mint_deposit + paid)
            used = spent + terms.buy_fee + terms.mint_deposit + paid
            move("RESERVED", "AVAILABLE", flow["reserved"] - used)
            flow |= {"cash": -used, "own": paid}
        elif flow and kind == 2:
            if not decide_ok or books["AVAILABLE"] < terms.sell_fee:
                out[trip] = ("SELL_PRE_SUBMIT_INSUFFICIENT_FUNDS_OPEN" if decide_ok else "SELL_REFERENCE_UNAVAILABLE_OPEN", flow["cash"], flow["own"])
                del state[trip]
            else:
                move("AVAILABLE", "RESERVED", terms.sell_fee)
        elif flow and kind == 3:
            move("RESERVED", "FEES", terms.sell_fee)
            if sell_ok:
                move("SPENT", "AVAILABLE", proceeds)
                move("LOCKED", "AVAILABLE", terms.mint_deposit)
            out[trip] = ("CLOSED", flow["cash"] - terms.sell_fee + proceeds + terms.mint_deposit, flow["own"]) if sell_ok else ("SELL_LANDED_FAILED_OPEN", flow["cash"] - terms.sell_fee, flow["own"])
            del state[trip]
    assert sum(books.values()) == terms.opening
    return out


def test_wallets_equal_plain_books(spark):
    rng = random.Random(10)
    statuses = set()
    for terms in (TERMS, replace(TERMS, opening=160)):
        acts, want = [], {}
        for wallet in range(40):
            own = []
            for trip in range(12):
                places, row = sorted(rng.sample(range(60), 4)), (rng.randint(80, 100), rng.random() < 0.8, rng.random() < 0.9, rng.random() < 0.8, rng.randint(60, 110))
                for kind, (phase, creator) in enumerate(((45, 0), (60, 0), (40, 1), (60, 2))):
                    own.append((places[kind], phase, places[creator], wallet * 100 + trip, kind, *row))
            want |= _run(own, terms)
            acts += [(wallet, *a) for a in own]
        frame = spark.createDataFrame(rng.sample(acts, len(acts)), roundtrips.ACTION)
        got = {r["event_id"]: (r["status"], r["cash"], r["locked"]) for r in roundtrips.settled(frame, terms).collect()}
        assert got == want
        statuses |= {s for s, _, _ in want.values()}
    assert statuses == {s for s in roundtrips.STATUSES if s not in ("COOLDOWN_SKIPPED", "BUY_REFERENCE_REJECTED", "OPEN_AT_HORIZON")}


def test_all_pairs_of_a_key(spark):
    left = [(1, i) for i in range(23)] + [(1, 5), (1, 5), (1, None), (2, 7), (3, 8), (None, 9)]
    right = [(1, i) for i in range(11)] + [(1, 3), (2, None), (2, 4), (4, 1), (None, 2)]
    frames = spark.createDataFrame(left, "k long, a long"), spark.createDataFrame(right, "k long, b long")
    want = sorted(str((k, a, b)) for k, a in left for m, b in right if k is not None and k == m)
    got = cells.all_pairs(*frames, "k", block=4, run=3, per_task=50)
    assert sorted(str((r["k"], r["a"], r["b"])) for r in got.collect()) == want
    wide = cells.all_pairs(frames[0].withColumn("c", F.col("a") + 1), frames[1].withColumn("d", F.lit("x")), "k", block=4, run=3)
    assert sorted(str((r["k"], r["a"], r["b"])) for r in wide.where("d = 'x' AND c IS NOT DISTINCT FROM a + 1").collect()) == want
    assert cells.all_pairs(frames[0].where("k = 9"), frames[1], "k").isEmpty()


def test_launch_pairs_take_little_disk(spark, tmp_path):
    """One venue with 200 trades and 20,000 launches: 4,000,000 rows, 16 MB by a plain join."""
    launches = spark.range(20_000).selectExpr("id * 20 + 1 AS event_id", "'signup' AS event_type", "id AS user_id")
    trades = spark.range(200).selectExpr("id AS event_id", "'click' AS event_type", "1L AS user_id")
    rest = "timestamp_ntz'2024-01-01 00:00:00' AS ts", "1D AS value", "'' AS props"
    launches.unionByName(trades).selectExpr("*", *rest).write.parquet(str(tmp_path / "events.parquet"))
    made = str(tmp_path / "made")
    registry.queries()["join_inner_trade_launch_eligible"](spark, str(tmp_path)).write.parquet(made)
    back = spark.read.parquet(made)
    assert back.agg(F.count("*"), F.sum("trade"), F.sum("launch")).first()[:] == (4_000_000, 199 * 100 * 20_000, (19_999 * 10_000 * 20 + 20_000) * 200)
    assert sum(p.stat().st_size for p in (tmp_path / "made").glob("*.parquet")) < 1_500_000
