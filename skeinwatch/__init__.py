"""Monitoring, trace, evaluation and corpus analytics as Spark DataFrame operators."""
