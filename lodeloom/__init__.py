"""Lodeloom: place-aware task analytics as Spark jobs."""
