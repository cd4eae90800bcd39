"""Whole jobs: building the knowledge base and linking a benchmark."""
