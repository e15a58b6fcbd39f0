"""Operators that take and give DataFrames of molecules, atoms, bonds, matches and reactions."""
