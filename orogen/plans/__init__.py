"""Composed plans: fixtures from fact tables, and the registered terrain queries."""
