"""DataFrame -> DataFrame operators (profiling, labels, splits, features, scaling, evaluation)."""
