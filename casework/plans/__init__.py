"""casework.plans."""
