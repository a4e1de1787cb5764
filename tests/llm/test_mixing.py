import pytest

from sluice.llm import mixing

DOCS = "doc_id long, text string, source string, uses int"
TARGETS = "source string, target_share double, max_repeats int"


def table(spark, sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((i, " word" * (k % 7 + 1), source, None))
            i += 1
    return spark.createDataFrame(rows, DOCS).repartition(4)


def test_shares_budgets_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_DOCUMENTS", 50)
    docs = table(spark, {"a": 900, "b": 200, "c": 20, "untold": 100, None: 30})
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 4), ("gone", 0.1, 5)], TARGETS)
    chosen, report = mixing.mix(docs, targets)
    rows = {r.source: r for r in report.collect()}
    total = rows["a"].total_tokens
    assert total == sum(r[0] for r in docs.select(mixing.token_count(docs.text)).collect())
    used = {}
    for r in chosen.collect():
        used.setdefault(r.source, []).append(r)
    for s, most in (("a", 1), ("b", 3), ("c", 4)):
        got = sum(r.n_tokens * r.uses for r in used[s])
        assert rows[s].actual_tokens == got and max(r.uses for r in used[s]) <= most and len({r.doc_id for r in used[s]}) == len(used[s])
        assert got <= rows[s].used_budget and got > rows[s].used_budget - 8
        assert max(r.uses for r in used[s]) - min(r.uses for r in used[s]) <= 1
    assert rows["a"].reachable and rows["b"].reachable and not rows["c"].reachable and not rows["gone"].reachable
    assert rows["c"].actual_tokens == 4 * rows["c"].tokens and rows["gone"].actual_tokens == 0 and set(used) == {"a", "b", "c"}
    assert sum(r.actual_share for r in rows.values()) == pytest.approx(1)
    # about a third of a's documents, spread over all its ids
    share = [sum(r.doc_id in range(q, q + 300) for r in used["a"]) for q in (0, 300, 600)]
    assert min(share) > 0.5 * max(share)


def test_ranges_do_not_change_the_rule(spark, monkeypatch):
    docs = table(spark, {"a": 300})
    targets = spark.createDataFrame([("a", 0.5, 2)], TARGETS)
    for size in (10, 100_000):
        monkeypatch.setattr(mixing, "RANGE_DOCUMENTS", size)
        r = mixing.mix(docs, targets)[1].first()
        assert r.budget - 8 < r.actual_tokens <= r.budget


def test_edges(spark):
    docs = table(spark, {"a": 10})
    targets = spark.createDataFrame([("a", None, None), ("a", 0.5, 1), (None, 0.5, 1), ("b", -1.0, 1)], TARGETS)
    rows = {r.source: r for r in mixing.mix(docs, targets)[1].collect()}
    assert set(rows) == {"a", "b"} and rows["a"].target_share == 0.5 and rows["b"].budget == 0 and rows["b"].reachable
    chosen, report = mixing.mix(docs.limit(0), targets)
    assert chosen.count() == 0 and {r.actual_tokens for r in report.collect()} == {0}
    chosen, report = mixing.mix(docs, targets.limit(0))
    assert chosen.count() == report.count() == 0
    odd = spark.createDataFrame([(1, None, "a", 0), (2, "", "a", 0), (None, "x " * 50_000, "a", 0), (None, "x", "a", 0)], DOCS)
    report = mixing.mix(odd, spark.createDataFrame([("a", 1.0, 1)], TARGETS))[1].first()
    assert report.docs == 4 and report.actual_tokens == report.tokens == report.budget


def test_same_mix_however_the_table_lies(spark, monkeypatch):
    docs = table(spark, {"a": 300, "b": 50})
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 2)], TARGETS)
    mixes = [sorted(map(tuple, mixing.mix(d, targets)[0].collect())) for d in (docs, docs.coalesce(1), docs.orderBy("text").repartition(7))]
    assert mixes[0] == mixes[1] == mixes[2] and len(mixes[0]) > 100
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs, targets)[0].collect())) == mixes[0]


def test_reachable_is_what_the_cut_finds(spark):
    docs = table(spark, {"a": 100, "b": 7, "c": 1})
    total = mixing.mix(docs, spark.createDataFrame([], TARGETS))[1].count()
    assert total == 0
    for share, most, want in ((0.07, 1, None), (0.5, 1, False), (0.0, 0, True), (0.01, 0, False)):
        r = mixing.mix(docs, spark.createDataFrame([("b", share, most)], TARGETS))[1].first()
        assert r.reachable == (r.tokens * r.max_repeats >= share * r.total_tokens) and want in (None, r.reachable)
    sure = mixing.mix(docs, spark.createDataFrame([("b", r.tokens / r.total_tokens, 1)], TARGETS))[1].first()
    assert sure.reachable
