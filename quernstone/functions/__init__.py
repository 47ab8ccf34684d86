"""Subpackage of quernstone."""
