"""Registered queries by family, each beside its SQL twin."""
