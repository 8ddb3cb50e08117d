"""Whole packs: configuration, assembly, rendering."""
