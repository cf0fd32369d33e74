"""Structured Streaming forms of the job and artifact registries."""
