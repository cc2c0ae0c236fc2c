"""Structured Streaming: continuous scans and bounded replay."""
