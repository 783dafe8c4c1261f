"""Structured Streaming variants of mergeable batch aggregates."""
