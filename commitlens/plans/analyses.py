"""The analyses by command name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from commitlens.model import Options
from commitlens.operators import age, churn, communication, counts, coupling, effort

ANALYSES: dict[str, Callable[[DataFrame, Options], DataFrame]] = {
    name: (lambda commits, options, f=f: f(commits))
    for name, f in {
        "authors": counts.authors,
        "revisions": counts.revisions,
        "summary": counts.summary,
        "identity": counts.identity,
        "abs-churn": churn.abs_churn,
        "author-churn": churn.author_churn,
        "entity-churn": churn.entity_churn,
        "entity-ownership": churn.entity_ownership,
        "main-dev": churn.main_dev,
        "refactoring-main-dev": churn.refactoring_main_dev,
        "main-dev-by-revs": effort.main_dev_by_revs,
        "entity-effort": effort.entity_effort,
        "fragmentation": effort.fragmentation,
        "communication": communication.communication,
    }.items()
} | {
    "age": lambda commits, options: age.age(commits, options.age_time_now),
    "coupling": coupling.coupling,
    "soc": coupling.sum_of_coupling,
}
