"""What a run has cost."""


def most_rows(df) -> int:
    """The most rows that a node of the plan put out, once ``df`` has been collected."""

    def of(node) -> int:
        inner = [getattr(node, f)() for kind, f in (("AdaptiveSparkPlan", "executedPlan"), ("QueryStage", "plan")) if kind in node.getClass().getSimpleName()]
        metric = node.metrics().get("numOutputRows")
        below = node.children()
        return max([metric.get().value() if metric.isDefined() else 0, *map(of, inner), *[of(below.apply(i)) for i in range(below.size())]])

    return of(df._jdf.queryExecution().executedPlan())
