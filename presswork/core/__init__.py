"""Contracts, JavaScript-compatible semantics and storage helpers."""
