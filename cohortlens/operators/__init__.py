"""DataFrame in, DataFrame out: the analytic, table and model operators."""
