"""Column-level building blocks: text, URL and stemming helpers."""
