"""Fixtures and registered queries of the driver contract."""
