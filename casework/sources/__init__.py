"""casework.sources."""
