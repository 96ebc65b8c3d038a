"""Rows that the operators of a query's plan make."""


def _steps(plan):
    kind = plan.getClass().getSimpleName()
    inside = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    children = plan.children()
    yield plan
    for x in inside + [children.apply(i) for i in range(children.size())]:
        yield from _steps(x)


def most_rows(df) -> int:
    """The most rows that one step makes, checkpointed parts left out; runs the query."""
    df.collect()
    made = (p.metrics().get("numOutputRows") for p in _steps(df._jdf.queryExecution().executedPlan()))
    return max(m.get().value() for m in made if m.isDefined())
