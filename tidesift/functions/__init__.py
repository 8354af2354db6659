"""Part of tidesift."""
