"""Operators of a training-data pipeline: near-duplicates, tokens, packing, secrets,
chat rendering, quality rules, language-model scores, shards and language ids."""
