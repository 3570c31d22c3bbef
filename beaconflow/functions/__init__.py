"""Column-level helpers and distributed rank helpers."""
