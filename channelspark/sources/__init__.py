"""Readers and writers for the tables of a measurement run."""
