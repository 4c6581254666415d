"""sources of driftloom."""
