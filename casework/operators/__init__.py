"""casework.operators."""
