"""Texts and phrases in, results out."""
