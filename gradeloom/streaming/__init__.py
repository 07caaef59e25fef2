"""Runs that write predictions as questions arrive."""
