"""Structured Streaming jobs: incremental encoding and scoring of landed text."""
