"""Structured Streaming jobs: requests, log metrics, the continuous cascade."""
