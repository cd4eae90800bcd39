"""The push-based page callback as a stream: edge counts kept up to date while pages arrive."""
