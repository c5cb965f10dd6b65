"""Spark-first analytics for meeting records: sources, text functions, relational operators, plans and streams."""
