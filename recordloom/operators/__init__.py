"""DataFrame-in, DataFrame-out operators of the record store."""
