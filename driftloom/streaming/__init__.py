"""streaming of driftloom."""
