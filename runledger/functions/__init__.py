"""Column-level building blocks: scoring arithmetic, text shape, coercion."""
