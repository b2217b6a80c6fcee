"""Part of veloframe; see README."""
