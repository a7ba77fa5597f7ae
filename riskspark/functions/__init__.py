"""Part of riskspark."""
