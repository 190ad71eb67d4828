"""Readers for the input tables and the reference's file formats."""
