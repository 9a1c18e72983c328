"""Operators for preparing training text: one module per operator, all run as Spark jobs."""
