"""Cleaning and type inference of raw text tables."""
