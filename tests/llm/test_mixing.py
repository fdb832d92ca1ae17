import pytest

from gridloom.llm import mixing

DOC = "doc_id long, source string, n_tokens long, u double, h string"
TARGET = "source_name string, target_share double, max_repeats int, steps string"


def run(spark, docs, targets):
    times, report = mixing.mix(spark.createDataFrame([(*d, 0.0, "x") for d in docs], DOC), spark.createDataFrame([(*t, "x") for t in targets], TARGET))
    return {r.doc_id: r.times for r in times.collect()}, {r.source_name: r for r in report.collect()}, times


def docs_of(source, n, size, start):
    return [(start + i, source, size + i % 7) for i in range(n)]


def test_shares_and_caps(spark):
    docs = docs_of("a", 3000, 50, 0) + docs_of("b", 400, 80, 10_000) + docs_of("c", 60, 300, 20_000) + [(90_000, None, 10), (90_001, "zzz", 10), (90_002, "a", 0)]
    times, report, _ = run(spark, docs, [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 5), ("none", 0.0, 2)])
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert report[s].reached_share == pytest.approx(share, abs=0.004)
    cap = {"a": 1, "b": 3, "c": 5}
    size = {d: (s, n) for d, s, n in docs}
    assert all(1 <= k <= cap[size[d][0]] for d, k in times.items())
    assert report["b"].tokens_used == sum(k * size[d][1] for d, k in times.items() if size[d][0] == "b")
    assert not {90_000, 90_001, 90_002} & set(times)
    assert report["none"].tokens_used == 0


def test_a_source_without_documents(spark):
    _, report, _ = run(spark, docs_of("a", 900, 20, 0) + docs_of("b", 900, 20, 5000), [("a", 0.45, 2), ("b", 0.45, 2), ("c", 0.1, 2)])
    assert report["c"].n_docs == 0 and report["c"].reached_share == 0
    assert report["a"].reached_share == pytest.approx(0.5, abs=0.01)


def test_the_same_each_time_and_sequence(spark):
    docs, targets = docs_of("a", 500, 20, 0) + docs_of("b", 100, 20, 5000), [("a", 0.6, 2), ("b", 0.4, 4)]
    first, _, times = run(spark, docs, targets)
    assert first == run(spark, docs[::-1], targets)[0]
    seq = mixing.sequence(times).collect()
    assert len(seq) == sum(first.values())
    assert [r.order_key for r in seq] == sorted(r.order_key for r in seq)


def test_edges(spark):
    assert run(spark, [], [("a", 1.0, 2)])[0] == {}
    assert run(spark, docs_of("a", 5, 9, 0), [])[0] == {}
    assert run(spark, docs_of("a", 5, 9, 0), [("a", None, None), (None, 1.0, 1)])[0] == {}
    times, report, _ = run(spark, docs_of("a", 5, 9, 0), [("a", 0.5, 3), ("a", 0.5, 2)])
    assert set(times.values()) == {3} and report["a"].target_share == 1.0


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_capped_poisson(cap):
    for mean in (0.05, 0.5, 0.95):
        rate = mixing.rate_for(mean * cap, cap)
        assert mixing.capped_mean(rate, cap) == pytest.approx(mean * cap, abs=1e-9)
        edges = mixing.steps(rate, cap)
        assert len(edges) <= cap and edges == sorted(edges)
        n = 200_000
        assert sum(sum(1 for e in edges if (i + 0.5) / n > e) for i in range(0, n, 50)) / (n / 50) == pytest.approx(mean * cap, abs=0.01)
