"""Operators by family: snapshot (A), reference (B), capacity (C),
workload (D), compliance (E), security (F), profile (G)."""
