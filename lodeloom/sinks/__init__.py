"""Writes that survive failures and repeats."""
