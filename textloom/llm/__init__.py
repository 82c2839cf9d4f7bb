"""Operators for preparing large text and code collections."""
