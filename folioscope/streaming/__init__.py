"""Log-driven jobs as Structured Streaming over file sources."""
