"""State bins learned from train rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.quantiles import column_quantiles
from stepweave.operators import baselines


@dataclass(frozen=True)
class Cut:
    """Edges of one state component; ``at`` is its place in the state."""

    component: str
    at: int
    edges: tuple[float, ...]


def fit_cuts(
    train: DataFrame, components: Mapping[str, int], features: Sequence[str], state: str = "state"
) -> list[Cut]:
    """Edges at equal shares of the train rows: ``components`` names how many bins each gets.

    ``features`` gives the order of the state. Equal edges are merged, so a
    component of few values has fewer bins; a component never observed has one.
    """
    unknown = [c for c in components if c not in features]
    if unknown:
        raise ValueError(f"unknown state components: {unknown}")
    few = [c for c, n in components.items() if n < 2]
    if few:
        raise ValueError(f"fewer than two bins asked for {few}")
    places = {c: list(features).index(c) for c in components}
    values = train.select(*(F.element_at(state, places[c] + 1).alias(c) for c in components))
    # all shares any component needs, in one pass over the values
    shares = sorted({i / n for n in components.values() for i in range(1, n)})
    found = column_quantiles(values, list(components), shares)
    cuts = []
    for c, n in components.items():
        seen, at_share = found[c]
        edges = {at_share[shares.index(i / n)] for i in range(1, n)} if seen else set()
        cuts.append(Cut(c, places[c], tuple(sorted(edges))))
    return cuts


def state_bin(cuts: Sequence[Cut], state: str = "state") -> Column:
    """Text code of a state: per component the number of its edges below the value."""
    return baselines.discretise(F.col(state), [(c.at, c.edges) for c in cuts])


def check_places(cuts: Sequence[Cut], features: Sequence[str]) -> None:
    """Stored cuts fit a state whose components stand where they stood when the cuts were learned."""
    moved = [c.component for c in cuts if c.at >= len(features) or features[c.at] != c.component]
    if moved:
        raise ValueError(f"state components are not where the stored cuts expect them: {moved}")
