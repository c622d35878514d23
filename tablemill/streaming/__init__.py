"""Incremental copies built on Structured Streaming."""
