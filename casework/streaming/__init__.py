"""casework.streaming."""
