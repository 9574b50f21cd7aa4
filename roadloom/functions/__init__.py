"""Part of the mobility engine."""
