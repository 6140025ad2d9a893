"""casework.functions."""
