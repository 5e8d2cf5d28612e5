"""Part of the pagemill engine."""
