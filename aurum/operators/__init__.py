"""Query, resolution, merge, history and management operators."""
