"""DataFrame operators: DataFrame(s) in, DataFrame out, nothing executed."""
