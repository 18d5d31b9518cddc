"""Live monitoring as Structured Streaming jobs."""
