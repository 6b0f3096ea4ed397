"""Resumable incremental jobs."""
