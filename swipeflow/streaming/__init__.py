"""Incremental landing of swipe files with Structured Streaming."""
