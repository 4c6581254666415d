"""functions of driftloom."""
