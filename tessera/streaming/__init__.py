"""Structured Streaming operators: tails of logs, count triggers and writes that happen once."""
