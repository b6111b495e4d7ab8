"""Versioned, tagged geographic data on Spark: tables, geometry, tiles and changes."""
