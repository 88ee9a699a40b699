"""Readers, driver-side acquisition and publishing."""
