"""Rollups and recipes over event tables."""
