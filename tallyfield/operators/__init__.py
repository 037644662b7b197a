"""DataFrame-to-DataFrame operators: joins, profiles, checks, baskets, splits, metrics."""
