"""Multi-step jobs: model training and search, scoring, and the query catalog."""
