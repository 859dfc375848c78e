"""Evaluation analytics for repeated-run benchmarks, written as Spark jobs."""
