"""Connected components, in one task while links are few and distributed beyond that."""

from placebook.llm import components


def test_few_links_are_not_shuffled_round_by_round(spark, monkeypatch):
    pairs = [(9, 4), (4, 1), (7, 9), (5, 5), (20, 21), (21, 22), (22, 23), (23, 24), *((100 + i, 90) for i in range(50)), (130, 20), (130, 20)]
    links = spark.createDataFrame(pairs, "a long, b long")
    want = {x: 1 for x in (1, 4, 7, 9)} | {x: 20 for x in (20, 21, 22, 23, 24, 90, *range(100, 150))}
    plans, stored = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), stored(df, label))[1])
    for few, shuffled in ((components.FEW, False), (len(pairs) // 2, True)):
        monkeypatch.setattr(components, "FEW", few)
        plans.clear()
        assert {r.id: r.component for r in components.components(links).collect()} == want
        stars = [plan for label, plan in plans if label.endswith("star")]
        assert stars and all(("hashpartitioning" in plan) == shuffled for plan in stars)
