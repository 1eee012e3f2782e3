"""DataFrame operators: identity, merge, resolution, ranking, reports."""
