"""Part of the tributary engine."""
