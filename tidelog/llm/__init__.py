"""Operators for training text: each is a Spark plan whose Python runs in Arrow batches inside tasks."""
