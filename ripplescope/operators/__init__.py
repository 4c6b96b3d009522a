"""DataFrame operators: graph closure, containment joins, module facts, deltas, roll-ups."""
