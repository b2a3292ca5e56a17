"""Agent-trace analytics on Spark."""
