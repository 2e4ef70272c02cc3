"""Readers of text, diffs, trees and settings."""
