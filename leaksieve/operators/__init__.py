"""Operators over lines and findings."""
